"""A corpus from raw documents: quality filter, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's rows and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.decontaminate import decontaminate
from runloom.llm.mixing import mix_documents
from runloom.llm.ngram_jaccard import ngram_jaccard_components
from runloom.llm.quality_classifier import scored, train
from runloom.llm.sharding import shard
from runloom.llm.tables import documents, keep_ids, saved, without_ids

#: SQL can express neither the classifier nor the hashes of the last stages; tests compare with plain Python.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Each row is judged by its own text, null and empty ones as well; equal rows stay or go together. Columns of any name pass through."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select("text", F.struct(*docs.columns).alias("document"))
    return scored(whole, model).where("predicted = 1").select("document.*")


def _own_ids(docs: DataFrame) -> bool:
    """Whether each row has a doc_id, and one that no other row has."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def _keyed(docs: DataFrame, own: bool) -> DataFrame:
    """row, which no two rows share, and document with all columns: doc_id is the row if that will do, else a number that is written with the rows."""
    document = F.struct(*docs.columns).alias("document")
    return docs.select(F.col("doc_id").alias("row"), document) if own else saved(docs.select(F.monotonically_increasing_id().alias("row"), document))


def _by_row(rows: DataFrame) -> DataFrame:
    """``rows`` for the operators, with row for doc_id."""
    return rows.select(F.col("row").alias("doc_id"), "document.text", "document.source")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five words, similarity 0.8.

    Of equal rows one stays, with or without words; different rows without words or text all stay.
    Rows that share a doc_id, or have none, are documents of their own; those without come last, so
    one of them stays only if its group has no other. Columns of any name pass through.
    """
    own = _own_ids(docs)
    rows = _keyed(docs if own else docs.dropDuplicates(), own)
    found = saved(ngram_jaccard_components(_by_row(rows)).select(F.col("doc_id").alias("row"), "component_id"))
    if not own:
        place = rows.select("row", F.struct(F.col("document.doc_id").isNull().alias("late"), "document.doc_id", "row").alias("place"))
        first = found.join(place, "row").groupBy("component_id").agg(F.min("place")["row"].alias("first"))
        found = saved(found.join(first, "component_id").select("row", F.col("first").alias("component_id")))
    return without_ids(rows, found.where("row != component_id").select("row"), "row").select("document.*")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, whole; proximity matches do not count. Each row is judged by its own text, whatever its doc_id; one without words stays. Columns of any name pass through."""
    rows = _keyed(docs, _own_ids(docs))
    found = saved(decontaminate(_by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return without_ids(rows, found.where("contaminated").select(F.col("doc_id").alias("row")), "row").select("document.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its words of a document over the document's size, to the nearest whole number, at most twice.

    The schedule's blocks begin and end within documents, but this stage hands on whole rows of the
    documents' columns, so slots and spans end here, and a source's words are off its target by the
    rounding. Each row comes as often as its own words are taken, whatever its doc_id; equal rows are
    taken one by one. A row without words is never taken. Columns of any name pass through.
    """
    rows = _keyed(docs, _own_ids(docs))
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    taken = saved(mix_documents(_by_row(rows)).where("taken > 0").select(F.col("doc_id").alias("row"), times.alias("times")).where("times > 0"))
    again = keep_ids(rows, taken.where("times > 1").select("row"), "row")
    return keep_ids(rows, taken.select("row"), "row").unionByName(again).select("document.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, one of eight, and slot; nulls and empty texts are rows like others, and copies may go to different shards. Columns named shard, slot or row_number are replaced."""
    return shard(docs, ["doc_id", "n_chars", "source"])


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
