"""Queries over texts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.evaluate import metrics
from quirework.functions import compress as C
from quirework.functions import refs as R
from quirework.functions import text as X
from quirework.operators import vocabulary as V
from quirework.plans import fixtures
from quirework.sources.adapters import typeset

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


LINES = "SELECT doc_id, (ord // 40)::INT AS page, ord::INT AS ord, trim(t, ' ') AS text, (60 + 12 * (ord % 40))::FLOAT AS baseline, (CASE WHEN ord = 0 THEN 14 ELSE 10 END)::FLOAT AS size, 72::FLOAT AS x0, (72 + 5 * length(trim(t, ' ')))::FLOAT AS x1 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents) WHERE trim(t, ' ') <> ''"
NORMALISED = r"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(coalesce(text, ''), '(?s)\$\$.*?\$\$|\$[^$\n]*\$', ' ', 'g')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({WORDS})::INT AS n_words, len({NORMALISED})::INT AS n_normalised, len(list_distinct({NORMALISED}))::INT AS n_distinct FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.normalise_words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", X.count_words(F.col("text")).alias("n_words"), F.size(words).alias("n_normalised"), F.size(F.array_distinct(words)).alias("n_distinct"))


_BIGRAMS = "list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]))"


@query(f"""WITH b AS (SELECT item_id, {NORMALISED} AS w FROM benchmark), d AS (SELECT doc_id, {NORMALISED} AS w FROM documents),
bg AS (SELECT item_id, len({_BIGRAMS}) AS n, unnest({_BIGRAMS}) AS g FROM b), dg AS (SELECT doc_id, unnest({_BIGRAMS}) AS g FROM d)
SELECT item_id, doc_id, round(count(*) / n, 6) AS recall FROM bg JOIN dg USING (g) GROUP BY item_id, doc_id, n HAVING count(*) / n >= 0.1""")
def bigram_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return metrics.bigram_recall(items, docs(spark, sf_dir)).filter("recall >= 0.1").select("item_id", "doc_id", F.round("recall", 6).alias("recall"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({NORMALISED}) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct({NORMALISED}) AS w FROM documents),
bg AS (SELECT item_id, len(w) AS n, unnest(w) AS g FROM b), dg AS (SELECT doc_id, unnest(w) AS g FROM d)
SELECT item_id, doc_id, round(count(*) / n, 6) AS coverage FROM bg JOIN dg USING (g) GROUP BY item_id, doc_id, n HAVING count(*) / n >= 0.5""")
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return metrics.coverage(items, docs(spark, sf_dir)).filter("coverage >= 0.5").select("item_id", "doc_id", F.round("coverage", 6).alias("coverage"))


def compress_sql(source: str, key: str, level: str) -> str:
    gone = ", ".join(f"'{w}'" for w in sorted(C.LIGHT if level == "light" else C.HARD))
    phrases = "m"
    for phrase, put in C.PHRASES.items():
        phrases = f"regexp_replace({phrases}, '(^|[^A-Za-z0-9])(?i:{phrase})([^A-Za-z0-9]|$)', '\\1{put}\\2', 'g')"
    opener = rf"^(?i:{C.OPENERS})(?:, | )\s*"
    cap = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
    return rf"""
WITH a AS (SELECT {key}, text, regexp_replace(text, '\$[^$]*\$', ' ' || chr(1) || chr(1) || ' ', 'g') AS m0, regexp_extract_all(text, '\$[^$]*\$') AS fs FROM {source}),
  o AS (SELECT *, CASE WHEN regexp_matches(m0, '{opener}') THEN {cap.format(f"regexp_replace(m0, '{opener}', '')")} ELSE m0 END AS m FROM a),
  p AS (SELECT *, list_filter(regexp_split_to_array({phrases}, '\s+'), lambda w: w <> '') AS ts FROM o),
  q AS (SELECT *, regexp_replace(array_to_string(list_transform(ts, lambda t: CASE WHEN list_contains([{gone}], lower(regexp_replace(t, '^[^\p{{L}}\p{{N}}\x01]+|[^\p{{L}}\p{{N}}\x01]+$', '', 'g'))) AND NOT contains(t, chr(1)) THEN regexp_replace(t, '[^.,;:?!)]+', '', 'g') ELSE ' ' || t END), ''), '^[^ ]* ?', '') AS k FROM p),
  r AS (SELECT *, string_split({cap.format("k")}, chr(1) || chr(1)) AS parts FROM q)
SELECT {key}, array_to_string(list_transform(list_zip(parts, fs), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') AS compressed FROM r"""


@query(compress_sql("documents", "doc_id", "light"))
def compress_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.compress(F.col("text"), "light").alias("compressed"))


@query(compress_sql("documents", "doc_id", "hard"))
def compress_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.compress(F.col("text"), "hard").alias("compressed"))


@query(compress_sql(fixtures.sql("prose"), "id", "hard"))
def compress_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "prose").select("id", C.compress(F.col("text"), "hard").alias("compressed"))


_BULLETS = X.BULLETS
_HEAD = r"regexp_extract(text, '^\s*(\S+)\s+\S', 1)"
_CORE = rf"regexp_replace(regexp_replace({_HEAD}, '^\(+', ''), '[).:]+$', '')"
_FLAGS = rf"""CASE WHEN regexp_matches(text, '^[{_BULLETS}]') THEN CASE WHEN regexp_matches(text, '^[{_BULLETS}]\s') THEN 'bullet' END
  WHEN {_HEAD} <> '' AND strlen({_HEAD}) <= 6 AND {_CORE} <> '' AND {_CORE} <> {_HEAD} AND regexp_matches({_CORE}, '^(?:[0-9]+|[ivxl]+|[A-Za-z])$') THEN 'ordered' END AS marker,
  regexp_matches(lower(substr(text, 1, 24)), '{X.CAPTION}') AND regexp_matches(lower(substr(text, 1, 24)), '[0-9]') AS caption,
  regexp_matches(text, '{X.NUMBERED}') AS numbered,
  CASE WHEN regexp_matches(text, '{X.NUMBERED}') THEN least(6, len(list_filter(string_split(regexp_replace(regexp_extract(text, '^\s*(\S+)', 1), '\.+$', ''), '.'), lambda p: p <> '')))::INT ELSE 0 END AS depth,
  trim(regexp_replace(lower(text), '[^\p{{L}}\s]', '', 'g'), ' ') IN ('references', 'bibliography', 'works cited', 'literature cited') AS bibliography,
  regexp_matches(text, '^\s*(?i:tab|table)[.:]*\s+(?:[0-9]+|[IVXL]+)[.:)]*(?:\s|$)') AS table_caption"""


def _flags(lines: DataFrame, *keys: str) -> DataFrame:
    t = F.col("text")
    marker = X.list_marker(t)
    return lines.select(*keys, F.when(marker, "ordered").when(~marker, "bullet").alias("marker"), X.is_caption(t).alias("caption"), X.numbered_heading(t).alias("numbered"), F.coalesce(X.numbering_depth(t), F.lit(0)).alias("depth"), X.is_bibliography_heading(t).alias("bibliography"), X.opens_table_caption(t).alias("table_caption"))


@query(f"WITH lines AS ({LINES}) SELECT doc_id, ord, {_FLAGS} FROM lines")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(typeset(docs(spark, sf_dir)), "doc_id", "ord")


@query(f"SELECT id, {_FLAGS} FROM {fixtures.sql('lines')}")
def line_kinds_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(fixtures.table(spark, "lines"), "id")


@query(rf"""SELECT id, CASE WHEN regexp_matches(text, '^[{_BULLETS}]') THEN regexp_replace(text, '^[{_BULLETS}]\s*', '') WHEN regexp_matches(text, '^\S*\s') AND strlen(regexp_extract(text, '^(\S*)\s', 1)) <= 6 THEN regexp_replace(text, '^\S*\s+', '') ELSE text END AS stripped,
regexp_replace(text, '^\s*([#>+=|-])', '\\\1') AS markdown,
array_to_string(list_transform(range(len(string_split(text, '$'))), lambda i: CASE WHEN i % 2 = 0 THEN regexp_replace(string_split(text, '$')[i + 1], '([#\[\]*_@\\<>])', '\\\1', 'g') ELSE string_split(text, '$')[i + 1] END), '$') AS typst FROM {fixtures.sql("lines")}""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return fixtures.table(spark, "lines").select("id", X.strip_marker(t).alias("stripped"), X.escape_markdown(t).alias("markdown"), X.escape_typst(t).alias("typst"))


@query(f"""WITH r AS (SELECT id, text, CASE WHEN regexp_full_match(text, '[IVX]+') THEN list_transform(string_split(text, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 ELSE 10 END) END AS d FROM {fixtures.sql("romans")})
SELECT id, regexp_full_match(text, '{X.ROMAN}') AS canonical, CASE WHEN list_sum(list_transform(range(len(d)), lambda i: CASE WHEN coalesce(list_max(d[i + 2:]), 0) > d[i + 1] THEN -d[i + 1] ELSE d[i + 1] END)) > 0 THEN list_sum(list_transform(range(len(d)), lambda i: CASE WHEN coalesce(list_max(d[i + 2:]), 0) > d[i + 1] THEN -d[i + 1] ELSE d[i + 1] END))::INT ELSE 0 END AS value FROM r""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "romans").select("id", X.is_roman(F.col("text")).alias("canonical"), F.coalesce(X.roman_value(F.col("text")), F.lit(0)).alias("value"))


_DASHES = "-‐‑‒–—"


@query(rf"""WITH e AS (SELECT entry_id, text, CASE WHEN strlen(regexp_extract(text, '^\s*\[([^\]]+)\]', 1)) BETWEEN 1 AND 12 THEN trim(regexp_replace(text, '^\s*\[[^\]]+\]', ''), ' ') ELSE trim(regexp_replace(text, '^\s*[0-9]{{1,3}}[.)](\s)', '\1'), ' ') END AS raw FROM {fixtures.sql("refs")}),
  c AS (SELECT *, regexp_replace(raw, '(?is)^(.*?arxiv:)[a-z0-9./-]+', '\1#') AS bare FROM e),
  i AS (SELECT entry_id, bare, unnest(range(1, length(bare) + 1)) AS i FROM c),
  y AS (SELECT entry_id, max_by(substr(bare, i, 4)::INT, i) AS year FROM i WHERE regexp_full_match(substr(bare, i, 4), '[0-9]{{4}}') AND NOT regexp_matches(substr(bare, i + 4, 1), '[0-9]') AND NOT (i > 1 AND regexp_matches(substr(bare, i - 1, 1), '[0-9]'))
    AND NOT regexp_matches(substr(bare, i + 4, 2), '^[{_DASHES}][0-9]') AND NOT (i > 2 AND regexp_matches(substr(bare, i - 2, 2), '^[0-9][{_DASHES}]')) AND substr(bare, i, 4)::INT BETWEEN 1800 AND 2100 GROUP BY entry_id),
  h AS (SELECT *, regexp_extract(raw, '(?s)^(.*?(?:[\p{{L}}\p{{N}}]{{2}}|\([0-9]{{4}}[A-Za-z]?\)))\.\s', 1) AS head, regexp_replace(raw, '(?s)^(.*?(?:[\p{{L}}\p{{N}}]{{2}}|\([0-9]{{4}}[A-Za-z]?\)))\.\s', '') AS rest FROM c),
  n AS (SELECT *, list_filter(list_transform(regexp_split_to_array(rtrim(regexp_replace(rtrim(head), '\([^(]*\)$', '')), '[,;]| and '), lambda x: trim(x, ' ')), lambda x: strlen(x) <= 60 AND regexp_matches(x, '^\p{{Lu}}')) AS names,
    list_filter(list_transform(string_split(rest, '. ')[1:3], lambda p: regexp_replace(trim(p, ' '), '\.+$', '')), lambda p: length(regexp_replace(p, '[^\p{{L}}]+', '', 'g')) * 4 > length(p) * 3 AND strlen(p) BETWEEN 8 AND 299) AS titles FROM h)
SELECT entry_id, CASE WHEN strlen(regexp_extract(text, '^\s*\[([^\]]+)\]', 1)) BETWEEN 1 AND 12 THEN regexp_extract(text, '^\s*\[([^\]]+)\]', 1) ELSE nullif(regexp_extract(text, '^\s*([0-9]{{1,3}})[.)]\s', 1), '') END AS label, coalesce(year, 0)::INT AS year,
  nullif(regexp_extract(raw, '(10\.[0-9]{{2,}}/\S*[^\s.,;])', 1), '') AS doi, nullif(regexp_replace(regexp_extract(raw, '(?is)^.*?arxiv:([a-z0-9./-]+)', 1), '\.+$', ''), '') AS arxiv,
  CASE WHEN strlen(head) < 200 AND len(names) >= 2 THEN array_to_string(names, '; ') ELSE '' END AS authors, CASE WHEN head <> '' THEN titles[1] END AS title FROM n LEFT JOIN y USING (entry_id)""")
def reference_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = fixtures.table(spark, "refs").select("entry_id", R.parse(F.col("text")).alias("r"))
    return parsed.select("entry_id", "r.label", F.coalesce("r.year", F.lit(0)).alias("year"), "r.doi", "r.arxiv", F.array_join("r.authors", "; ").alias("authors"), "r.title")


@query(f"""WITH g AS (SELECT id, text, regexp_extract(text, '^([^\\[]*)', 1) AS head, regexp_extract_all(text, '\\[[^\\]]*\\][^\\[]*|\\[[^\\]]*$') AS gs FROM {fixtures.sql("citations")})
SELECT id, head || array_to_string(list_transform(gs, lambda g: CASE WHEN contains(g, ']') AND len(list_filter(string_split(regexp_extract(g, '^\\[([^\\]]*)\\]', 1), ','), lambda p: trim(p, ' ') NOT IN ('1', '2', '3'))) = 0
  THEN '[' || array_to_string(list_transform(string_split(regexp_extract(g, '^\\[([^\\]]*)\\]', 1), ','), lambda p: '[' || trim(p, ' ') || '](#ref-' || trim(p, ' ') || ')'), ', ') || ']' || regexp_extract(g, '\\]([^\\[]*)$', 1) ELSE g END), '') AS linked FROM g""")
def linked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "citations").select("id", R.link_citations(F.col("text"), F.array(*map(F.lit, ("1", "2", "3")))).alias("linked"))


@query("SELECT * FROM (VALUES (0, '[1] A. Baker, C. D. Dole, and E. Fisk. On the persistence of hidden states. Letters on Networks, 5(2):157-166, 1994.'), (1, '[2] Adler, K., Loos, M., and Mann, C. (2019). Where do readers look first? arXiv:1907.01234.'), (2, '[3] Fundamenta Arithm. 31 (2019), 1822–1840.')) v(\"at\", entry)")
def split_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the fixture run together and split again."""
    whole = fixtures.table(spark, "refs").filter("entry_id IN (1, 2, 3)").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "text"))), lambda e: F.concat(F.lit("["), e["entry_id"].cast("string"), F.lit("] "), F.regexp_replace(e["text"], r"^(\[[0-9]+\]|[0-9]+\.)\s*", ""))), " ").alias("t"))
    return whole.select(F.posexplode(R.split_entries("t")).alias("at", "entry"))


@query(rf"""WITH lines AS ({LINES}), w AS (SELECT doc_id, {WORDS} AS w FROM lines), i AS (SELECT doc_id, unnest(w[2:len(w) - 1]) AS w FROM w WHERE len(w) >= 3)
SELECT doc_id, lower(w) AS word, count(*) AS n FROM i WHERE regexp_full_match(w, '[\p{{L}}-]+') GROUP BY ALL""")
def document_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vocabulary(typeset(docs(spark, sf_dir)))


_CUT = "SELECT doc_id, 0 AS page, k::INT AS ord, substr(t, k * 60 + 1, 60) AS text FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t, unnest(range((length(text) + 59) // 60)) AS k FROM documents)"


@query(rf"""WITH lines AS MATERIALIZED ({_CUT}), ws AS MATERIALIZED (SELECT doc_id, ord, {WORDS} AS w FROM lines), i AS (SELECT doc_id, unnest(w[2:len(w) - 1]) AS w FROM ws WHERE len(w) >= 3), v AS MATERIALIZED (SELECT doc_id, lower(w) AS word, count(*) AS n FROM i WHERE regexp_full_match(w, '[\p{{L}}-]+') GROUP BY ALL),
  s AS (SELECT doc_id, ord, w[-1] AS head, lead(w) OVER (PARTITION BY doc_id ORDER BY ord) AS nx FROM ws), t AS (SELECT doc_id, ord, head, nx[1] AS tail FROM s),
  m AS MATERIALIZED (SELECT *, lower(head || tail) AS merged FROM t WHERE regexp_full_match(head, '[\p{{L}}-]+') AND regexp_full_match(tail, '[\p{{L}}-]+') AND length(tail) >= 2 AND NOT regexp_matches(tail, '^\p{{Lu}}') AND length(head || tail) >= 6 AND replace(tail, '-', '') <> '')
SELECT m.doc_id, ord, head, tail, merged, coalesce(a.n, 0) > 0 AND coalesce(a.n, 0) >= greatest(coalesce(b.n, 0) * 2, 1) AS joins FROM m LEFT JOIN v a ON a.doc_id = m.doc_id AND a.word = merged LEFT JOIN v b ON b.doc_id = m.doc_id AND b.word = lower(tail)""")
def word_rejoining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into lines of sixty characters, within words as well."""
    # one pass over each text: a substring for each line would read it from its beginning again
    cut = F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("(?s).{1,60}"), 0)
    lines = docs(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), F.posexplode_outer(cut).alias("ord", "text")).filter("text IS NOT NULL")
    return V.rejoin_candidates(lines, V.vocabulary(lines))
