"""Fixtures that the operators of the subpackage must all survive."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, value long, fp long, uid long"


def rows(spark, values):
    """A documents table with clashing extra columns: (doc_id, text[, lang])."""
    return spark.createDataFrame([(v[0], v[1], v[2] if len(v) > 2 else None, None, None, "p", 1, 2, 3) for v in values], SCHEMA)


LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
EDGE = [
    (1, "the cat sat on the mat and the dog sat on the cat " * 8), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG), (6, LONG), (None, "no id here"), (None, None),
    (7, "Grüße aus 東京 🎉 naïve café"), (8, "a"), (9, "a b"), (10, "\x00 \x1f \x85 \xa0   mix"),
]


def real(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")
