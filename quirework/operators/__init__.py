"""DataFrame operators over lines, blocks and primitives of documents."""
