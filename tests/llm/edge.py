"""Small tables with everything that can be odd about documents, and plain-Python readings."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside; as extra columns of the input they must do no harm.
CLASHES = [
    "row", "size", "score", "batch", "hash", "label", "copies", "n", "cid", "place", "group",
    "part", "stats", "digest", "gone", "lines", "kept", "blob", "spans", "u", "merit", "shard",
    "slot", "need", "target", "group_key", "pos", "entity", "kind", "rank", "check", "errors",
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, rows):
    """Documents from (doc_id, text, source), with clashing extra columns."""
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    return docs.withColumns({name: F.lit(f"extra {name}") for name in CLASHES})


def prose(start, n):
    """`n` words, different for every `start`."""
    return " ".join(f"w{start}x{i * 7 % 1000}" for i in range(n))


def odd_rows():
    base = prose(1, 120)
    return [
        (1, base, "a"),
        (2, base.replace("w1x7 ", "other "), "a"),
        (3, base.upper().replace("X", "x").replace("W", "W"), None),
        (4, None, "a"),
        (5, "", None),
        (6, "   \n\t ", "b"),
        (7, "one two", "b"),
        (8, "one  TWO", "b"),
        (9, "one two three four five", "é"),
        (9, "one two three four five", "é"),
        (10, prose(2, 20_000), "b"),
        (None, base, "c"),
        (None, base.replace("w1x49 ", "changed "), "c"),
        (None, None, None),
        (11, "word " * 300, "c"),
        (12, "a\n\nb\n" + "A line that is long enough to count as a repeated one\n" * 2, "a"),
        (13, "  a line that is long enough to COUNT as a repeated one\r\nz", "a"),
        (14, "a line that is long enough to count as a repeated one", "b"),
        (15, "a line that is long enough to count as a repeated one", "b"),
        (16, "x\na line that is long enough to count as a repeated one\t", "\U0001f600"),
        (17, prose(1, 120), "zz"),
    ]
