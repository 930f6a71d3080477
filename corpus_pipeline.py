"""A training-data pipeline of the text operators, stage by stage over the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Null and empty texts go in the first stage, as bad documents. Rows that repeat are near
duplicates of each other. Empty tables pass through all stages. Extra columns of docs, of whatever
name, are carried along.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.llm import decontaminate, jaccard_join, mixing, quality, token_store
from weirlight.llm._shared import discard, fresh, materialise, working_tables
from weirlight.llm.queries import tokenizer_path

#: Working tables of calls of each stage whose results may still be unread, by the stage's place.
_open: dict[int, list[list[str]]] = {}


def stage(place: int):
    """A stage called by itself, whose working tables go when the next stage begins.

    The next stage gets what was written of the result, so the tables of the call before it are not read
    any more. That call is known where there is only one; if there are several, their tables stay.
    """

    def wrap(f):
        @functools.wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = _open.get(place - 1, [])
            if len(before) == 1:
                discard(spark, *before.pop())
            with working_tables() as mine:
                out = f(spark, docs, sf_dir)
            _open.setdefault(place, []).append(mine)
            return out

        run_stage.plain = f
        return run_stage

    return wrap


@stage(0)
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 3, 1)
    out = fresh(docs, "quality")
    return quality.score_documents(docs, model, out=out).where(F.col(f"{out}.score") >= 0.5).drop(out)


@stage(1)
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by id of each near-duplicate class."""
    classes = jaccard_join.jaccard_classes(docs, keep=tuple(docs.columns))
    return classes.where("first_of_class").select("kept.*")


@stage(2)
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    out = fresh(docs, "hits")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return found.where(F.size(out) == 0).drop(out)


@stage(3)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut comes whole."""
    taken = mixing.mix_documents(docs, keep=tuple(docs.columns))
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    again = taken.where("taken > 0").withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    return again.select("kept.*")


@stage(4)
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mix, read back."""
    return token_store.read_store(token_store.write_store(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_ids),
]

#: The tokenizer and the classifier are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. Each stage's result is written, and its working tables and docs go then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, one in STAGES[:-1]:
        before = docs
        with working_tables() as mine:
            found = one.plain(spark, before, sf_dir)
        docs = materialise(found, "stage-" + name.split()[0])
        discard(spark, before, *mine)
    return STAGES[-1][1].plain(spark, docs, sf_dir)
