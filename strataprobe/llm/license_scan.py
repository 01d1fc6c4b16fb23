"""License scan: which licence wordings a document holds, and where.

MinHash bands over overlapping windows of the text retrieve templates; the
number of bands is set so that a window that holds four fifths of a template's
shingles is missed with a probability of at most one in a million; exact shingle
containment in the whole text verifies each.  See ``containment``.

Defined results: null and empty texts hold nothing; texts that hold several
templates give a row for each; repeated rows give their own rows; an empty table
gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from .batches import bound_batches
from .containment import ContainmentIndex
from .decontamination import match_column
from .license_templates import TEMPLATES


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row per document and template: id, license, wording, n_template_shingles, n_shared, containment, window_word."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(ContainmentIndex(list(templates), list(templates.values()), k, threshold))
    found = docs.select(col(id_col).alias("id"), match_column(shared, col(text_col)).alias("matches")).where(F.size("matches") > 0)
    rows = found.select("id", F.explode("matches").alias("m"))
    name = F.split("m.item", "/")
    return rows.select(
        F.col("id").alias(id_col),
        name[0].alias("license"),
        name[1].alias("wording"),
        F.col("m.n_item").alias("n_template_shingles"),
        F.col("m.n_shared").alias("n_shared"),
        (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"),
        F.col("m.first_word").alias("window_word"),
    )
