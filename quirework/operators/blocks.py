"""Lines into typed blocks, with a title and levels of headings."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions import text as X
from quirework.operators.groups import whole_groups
from quirework.operators.vocabulary import may_rejoin, rejoins

#: ``SPACE`` of ``functions.text`` as Python has it.
_SPACE = re.compile("[ \\t\\n\\x0b\\f\\r\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def grouped(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """The lines with ``group``: a new one at another size, at a step back, and at a step beyond 1.45 leadings."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    step = F.col("baseline") - F.lag("baseline").over(w)
    new = F.coalesce((F.abs(F.col("size") - F.lag("size").over(w)) > 0.4) | (step <= 0) | (step > F.col("leading") * 1.45), F.lit(True))
    return lines.join(stats, "doc_id").withColumn("_new", new.cast("int")).withColumn("group", F.sum("_new").over(w)).drop("_new")


def _joined(pieces: Column, right: Column, words: Column) -> Column:
    """Lines as one text: across a break that reaches the right edge, halves of a word are put together again."""

    def count(w: Column) -> Column:
        return F.coalesce(F.try_element_at(words, w), F.lit(0).cast("long"))

    def merged(head: Column, tail: Column) -> Column:
        whole = may_rejoin(head, tail)
        return F.when(rejoins(count(whole), count(F.lower(tail))), F.concat(head, tail))

    def add(acc: Column, line: Column) -> Column:
        head, tail = F.substring_index(acc["text"], " ", -1), F.substring_index(line["text"], " ", 1)
        stem = F.regexp_replace(head, "[-‐]$", "")
        hyphen = F.when(stem != "", F.coalesce(merged(stem, tail), F.when(tail.rlike(r"^[\p{L}\p{N}-]+$"), F.concat(head, tail))))
        word = F.when((head != "") & (tail != "") & (right - acc["x1"] <= acc["size"]), F.when(head.rlike("[-‐]$"), hyphen).otherwise(merged(head, tail)))
        cut = F.substring(acc["text"], F.lit(1), F.length(acc["text"]) - F.length(head))
        rest = F.substring(line["text"], F.length(tail) + 1, F.length(line["text"]))
        out = F.when(acc["text"].isNull(), line["text"]).otherwise(F.coalesce(F.concat(cut, word, rest), F.concat(acc["text"], F.lit(" "), line["text"])))
        return F.struct(out.alias("text"), line["x1"].alias("x1"), line["size"].alias("size"))

    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("float").alias("x1"), F.lit(0).cast("float").alias("size"))
    return F.trim(F.aggregate(pieces, start, add)["text"])


class _Words:
    """Counts of a document's words, as of ``vocabulary``, from its lines: only if a word that is asked for occurs at all."""

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.low, self.counts = lines, "\n".join(lines).lower(), None

    def count(self, word: str) -> int:
        if word not in self.low:
            return 0
        if self.counts is None:
            self.counts = Counter(w.lower() for t in self.lines for w in [x for x in _SPACE.split(t) if x][1:-1] if _letters(w))
        return self.counts[word]


def _letters(word: str) -> bool:
    bare = word.replace("-", "")
    return bare.isalpha() or (bare == "" and word != "")


def _across(head: str, tail: str, words: _Words) -> str | None:
    """What both sides of a break are together, if they aren't two words: ``_joined`` in Python."""

    def merged(head: str) -> str | None:
        whole = (head + tail).lower()
        if not (_letters(head) and _letters(tail) and len(tail) >= 2 and unicodedata.category(tail[0]) != "Lu" and len(whole) >= 6 and tail.replace("-", "")):
            return None
        n = words.count(whole)
        return head + tail if n > 0 and n >= words.count(tail.lower()) * 2 else None

    if head[-1] not in "-‐":
        return merged(head)
    if head[:-1] == "":
        return None
    both = merged(head[:-1])
    return head + tail if both is None and all(c == "-" or unicodedata.category(c)[0] in "LN" for c in tail) else both


def _with_text(groups: DataFrame) -> DataFrame:
    """Groups of lines with ``text`` and their place ``ord``, without blank ones: ``_joined`` by the words of each document.

    Documents come whole and in order, as the window leaves them.  Words are counted for those documents alone at
    whose breaks they are asked for, and no table of words is made.
    """
    schema = T.StructType([*(f for f in groups.schema.fields if f.name != "_pieces"), T.StructField("text", T.StringType()), T.StructField("ord", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are Python's for some groups at a time
        few = (batch.slice(k, 2048) for batch in batches for k in range(0, batch.num_rows, 2048))
        for table, doc, starts in whole_groups(few, ["doc_id"]):
            pieces = table.column("_pieces").combine_chunks()
            at = pieces.offsets.to_numpy()
            lines = pieces.values.field("text").to_pylist()
            x1, size = (pieces.values.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "size"))
            right = np.repeat(table.column("x1").to_numpy(), np.diff(at))
            # breaks at the right edge, but not where a group ends
            close = np.zeros(at[-1] + 1, bool)
            close[at[0] : at[-1]] = right - x1[at[0] : at[-1]] <= size[at[0] : at[-1]]
            close[at[1:] - 1] = False
            some = np.add.reduceat(close, at[:-1]) > 0 if len(at) > 1 else np.zeros(0, bool)
            texts, words, of = [], None, -1
            void = pieces.values.field("text").null_count > 0
            for g, (a, b, look) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), some.tolist(), strict=True)):
                if void and None in lines[a:b]:
                    # a line without text is where a text begins anew
                    a = max(k for k in range(a, b) if lines[k] is None) + 1
                    if a == b:
                        texts.append("")
                        continue
                if not look:
                    texts.append(" ".join(lines[a:b]).strip(" "))
                    continue
                if of != doc[g]:
                    of, last = doc[g], starts[doc[g] + 1] if doc[g] + 1 < len(starts) else table.num_rows
                    words = _Words([t for t in lines[at[starts[of]] : at[last]] if t is not None])
                said = lines[a]
                for k in range(a + 1, b):
                    line, word = lines[k], None
                    if close[k - 1]:
                        head, tail = said[said.rfind(" ") + 1 :], line.split(" ", 1)[0]
                        word = _across(head, tail, words) if head and tail else None
                    said = f"{said} {line}" if word is None else said[: len(said) - len(head)] + word + line[len(tail) :]
                texts.append(said.strip(" "))
            kept = np.array([t != "" for t in texts], bool)
            place = np.cumsum(kept) - kept
            out = table.drop_columns(["_pieces", "_at"]).append_column("text", pa.array(texts, pa.string())).append_column("ord", pa.array(place - place[starts][doc], pa.int32()))
            yield from out.filter(pa.array(kept)).to_batches()

    return groups.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "group"))).mapInArrow(run, schema)


def _is_heading() -> Column:
    n, t = X.count_words(F.col("text")), F.col("text")
    numbered = X.numbered_heading(t)
    return (F.col("n_lines") <= 2) & n.between(1, 14) & (~t.endswith(".") | numbered) & (F.col("widest") / F.col("column_width") <= 0.9) & (numbered | (F.col("size") >= F.col("body_size") * F.lit(1.06).cast("float")) | F.col("all_bold"))


def raw_blocks(lines: DataFrame, stats: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """One row per group of lines, classified by itself: caption, heading, list item, footnote or paragraph.

    ``words`` (``doc_id, word, n``) speak for words that breaks have cut; without them those of the lines themselves do.
    """
    column = F.greatest(F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("doc_id", "page")), F.lit(1.0))
    # by document at once, which serves what goes by page or by group as well
    each = grouped(lines.repartition("doc_id"), stats).withColumn("column_width", column)
    piece = F.struct("ord", "text", "x1", "size")
    out = each.groupBy("doc_id", "page", "group").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces"), F.count(F.lit(1)).alias("n_lines"), F.min("ord").alias("start"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max(F.col("x1") - F.col("x0")).alias("widest"), F.first("column_width").alias("column_width"), F.min_by("size", "ord").alias("size"), F.bool_and("bold").alias("all_bold"), F.first("body_size").alias("body_size"), F.first("leading").alias("leading"), F.first("page_height").alias("page_height"),
    )
    if words is None:
        joined = _with_text(out)
    else:
        maps = words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("_words"))
        said = out.join(maps, "doc_id", "left").withColumn("text", _joined(F.col("_pieces"), F.col("x1"), F.coalesce("_words", F.expr("cast(map() as map<string,bigint>)")))).filter("text <> ''")
        joined = said.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "group")) - 1)
    footnote = (F.col("page_height") > 0) & (F.col("size") < F.col("body_size") * 0.92) & (F.col("y0") / F.col("page_height") >= 0.68)
    marker = X.list_marker(F.col("text"))
    kind = F.when(X.is_caption(F.col("text")), "caption").when(_is_heading(), "heading").when(marker.isNotNull(), "list_item").when(footnote, "footnote").otherwise("paragraph")
    ranked = joined.withColumn("type", kind).withColumn("ordered", F.when(kind == "list_item", marker))
    return ranked.select("doc_id", "ord", "type", F.lit(None).cast("int").alias("level"), "ordered", "text", "page", "x0", "y0", "x1", "y1", "size", "start", "body_size", "leading")


def coalesce_fragments(blocks: DataFrame) -> DataFrame:
    """Paragraphs of up to three words go to the paragraph before, if they lie below or beside it.

    The box of that paragraph grows as it takes them, so that this is a fold over the blocks of a document.  Documents
    come whole and in order, as the window leaves them; only paragraphs of a few words after another one are looked at.
    """
    schema = blocks.schema
    heads = {"references", "bibliography", "works cited", "literature cited"}
    sides = ("x0", "y0", "x1", "y1")

    def bibliography(t: str) -> bool:
        return "".join(c for c in t.lower() if c.isalpha() or c.isspace()).strip() in heads

    def fold(table: pa.Table, doc: np.ndarray, starts: np.ndarray) -> pa.Table:
        paragraph = pc.equal(table.column("type"), "paragraph").to_numpy()
        page = table.column("page").to_numpy()
        after = np.flatnonzero(paragraph[1:] & paragraph[:-1] & (doc[1:] == doc[:-1]) & (page[1:] == page[:-1])) + 1
        texts = table.column("text")
        few = [(i, t) for i, t in zip(after.tolist(), texts.take(pa.array(after)).to_pylist(), strict=True) if len(t.split(None, 3)) <= 3]
        box = {k: table.column(k).to_numpy().astype(np.float64) for k in (*sides, "leading")} if few else {}
        x0, y0, x1, y1 = (box.get(k) for k in sides)
        kept, grown = np.ones(table.num_rows, bool), {}
        at = -1
        for i, t in few:
            # the paragraph before is the last row, or the one that has taken it
            at = i - 1 if kept[i - 1] else at
            before = grown.get(at)
            end = before[-1] if before else texts[at].as_py()
            opens = t[:1].isupper() and end.endswith((".", ":", "?", "!"))
            below = y0[i] - y1[at] <= box["leading"][i] * 1.6 and min(x1[at], x1[i]) > max(x0[at], x0[i])
            shorter = max(1.0, min(y1[at] - y0[at], y1[i] - y0[i]))
            beside = min(y1[at], y1[i]) - max(y0[at], y0[i]) >= shorter * 0.5 and x0[i] >= x0[at]
            if not opens and not bibliography(t) and (below or beside):
                if before:
                    before.append(t)
                else:
                    grown[at] = [end, t]
                kept[i] = False
                x0[at], y0[at], x1[at], y1[at] = min(x0[at], x0[i]), min(y0[at], y0[i]), max(x1[at], x1[i]), max(y1[at], y1[i])
        if grown:
            new = np.zeros(table.num_rows, bool)
            new[list(grown)] = True
            said = pc.replace_with_mask(texts.combine_chunks(), pa.array(new), pa.array([" ".join(grown[i]) for i in sorted(grown)], texts.type))
            table = table.set_column(table.column_names.index("text"), "text", said)
            for k in sides:
                table = table.set_column(table.column_names.index(k), k, pa.array(box[k]).cast(table.schema.field(k).type))
        held = np.cumsum(kept) - 1
        out = table.set_column(table.column_names.index("ord"), "ord", pa.array(held - held[starts][doc], table.schema.field("ord").type))
        return out.filter(pa.array(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, doc, starts in whole_groups(batches, ["doc_id"]):
            yield from fold(table.drop_columns(["_at"]), doc, starts).to_batches()

    return blocks.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).mapInArrow(run, schema)


def demote_lonely_items(blocks: DataFrame) -> DataFrame:
    """List items without another within two blocks on their page are paragraphs."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(-2, 2)
    pages = F.collect_list(F.when(F.col("type") == "list_item", F.col("page"))).over(w)
    lonely = (F.col("type") == "list_item") & (F.size(F.filter(F.col("_pages"), lambda p: p == F.col("page"))) < 2)
    out = blocks.withColumn("_pages", pages).withColumn("_lonely", lonely)
    return out.withColumn("type", F.when(F.col("_lonely"), "paragraph").otherwise(F.col("type"))).withColumn("ordered", F.when(~F.col("_lonely"), F.col("ordered"))).drop("_pages", "_lonely")


def promote_title(blocks: DataFrame) -> DataFrame:
    """Of the first four blocks, the largest on the first page that reads like a title."""
    n, t = X.count_words(F.col("text")), F.col("text")
    may = (F.col("ord") < 4) & (F.col("page") == 0) & (F.col("size") >= F.col("body_size")) & n.between(2, 25) & ~t.endswith(".") & ~X.numbered_heading(t)
    best = F.max(F.when(may, F.struct("size", n.alias("n"), "ord"))).over(Window.partitionBy("doc_id"))["ord"]
    found = blocks.withColumn("_best", best)
    title = F.col("ord").eqNullSafe(F.col("_best"))
    return found.withColumn("ordered", F.when(~title, F.col("ordered"))).withColumn("type", F.when(title, "title").otherwise(F.col("type"))).drop("_best")


def heading_levels(blocks: DataFrame) -> DataFrame:
    """Levels of headings: the depth of the number; else that of the first numbered one of about its size; else the rank of the size."""
    depth = F.when(F.col("type") == "heading", X.numbering_depth(F.col("text")))
    w = Window.partitionBy("doc_id")
    known = F.array_sort(F.collect_list(F.when(F.col("_depth").isNotNull(), F.struct("ord", "size", F.col("_depth").alias("depth")))).over(w))
    sizes = F.sort_array(F.collect_set(F.when(F.col("type") == "heading", F.col("size"))).over(w), asc=False)
    with_all = blocks.withColumn("_depth", depth).withColumn("_known", known).withColumn("_sizes", sizes)
    like = F.try_element_at(F.filter("_known", lambda k: F.abs(k["size"] - F.col("size")) < 0.25), F.lit(1))["depth"]
    # distinct sizes, largest first, each kept if it is a quarter point below the one kept before
    steps = F.aggregate("_sizes", F.array().cast("array<float>"), lambda acc, s: F.when((F.size(acc) == 0) | (F.abs(F.try_element_at(acc, F.lit(-1)) - s) >= 0.25), F.concat(acc, F.array(s))).otherwise(acc))
    rank = F.coalesce(F.try_element_at(F.filter(F.transform(steps, lambda s, i: F.when(F.abs(s - F.col("size")) < 0.25, i + 1)), lambda r: r.isNotNull()), F.lit(1)), F.lit(1))
    level = F.greatest(F.coalesce("_depth", like, F.least(rank, F.lit(6))), F.lit(1))
    return with_all.withColumn("level", F.when(F.col("type") == "heading", level.cast("int"))).drop("_depth", "_known", "_sizes")


def assemble(lines: DataFrame, stats: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Lines in reading order as blocks: ``doc_id, ord, type, level, ordered, text, page, x0, y0, x1, y1, size, start``."""
    blocks = heading_levels(promote_title(demote_lonely_items(coalesce_fragments(raw_blocks(lines, stats, words)))))
    return blocks.drop("body_size", "leading")
