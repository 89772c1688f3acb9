"""A training corpus from the documents table: filtered, deduplicated, decontaminated, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages shuffle and learn, so SQL can't express their rows; the tests hold each against a plain version of it.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of any name are
defined stage by stage in the docstrings of the functions named in STAGES.
"""

from lodegraph.llm.decontaminate import without_leaks
from lodegraph.llm.mixing import mixed_copies
from lodegraph.llm.ngram_join import one_of_each
from lodegraph.llm.quality import keep_good
from lodegraph.llm.sharding import op2_sharding


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them, in the order that its splitting tree deals; cases as in mixed_copies."""
    return mixed_copies(docs)


def shard_records(spark, docs, sf_dir):
    """Shards and slots of what is left; texts that the mix repeats get a slot for each copy; cases as in op2_sharding."""
    return op2_sharding(spark, sf_dir, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard_records),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another over all documents, each written and read again; no documents give no rows."""
    from lodegraph.sources.tables import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
