"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but
the last return the columns of ``documents``.  Between stages the rows are written as Parquet to the
shared folder and read again, so a lost executor costs at most the stage that runs.
"""

from pyspark.sql import functions as F

from siftwarden.llm import decontam, jaccard, langid, packing, pii
from siftwarden.llm.common import possible, stored

MIN_SCORE = 0.1


def plain(docs):
    """The rows under names of our own, and a function from these names to the input's, so that no column clashes."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(rows, names, docs, **changed):
    """The columns of ``docs``, by name and type, those in ``changed`` with new values."""
    return rows.select(*[changed.get(name, F.col(inner)).cast(docs.schema[name].dataType).alias(name) for name, inner in names.items()])


def key_of(names):
    """A hash of a row's id and text; a null is told from any value."""
    parts = [F.col(names[c]).cast("string") for c in ("doc_id", "text")]
    return F.xxhash64(*[x for p in parts for x in (p.isNull(), p)])


def identify_language(spark, docs, sf_dir):
    """Documents without letters, or far from every profile, go; ``lang`` is what was identified.

    Profiles, and the least score of each language, are learnt from the labelled documents; without labels
    there is no model, and all go.  ``MIN_SCORE`` is the floor, and stands alone for a language with too few
    documents to learn from.
    """
    rows, names = plain(docs)
    of = {"lang_col": names["lang"], "text_col": names["text"], "id_col": names["doc_id"]}
    found = langid.identify(rows, langid.learn(rows, **of), text_col=names["text"])
    # stored first, as a broadcast has a time limit
    least = stored(langid.least_scores(rows, **of), "least").select(F.col("lang_pred").alias("of"), "least")
    found = found.join(least, F.col("lang_pred") == F.col("of"), "left")
    limit = F.greatest(F.lit(MIN_SCORE), F.coalesce("least", F.lit(MIN_SCORE)))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= limit))
    return named(kept, names, docs, lang=F.col("lang_pred"))


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of similar documents (five words, 80 %) one stays: that of the smallest id, then of the smallest hash.

    Documents are told apart by a hash of id and text, so rows that share an id, or have none, are documents each;
    of rows that agree in both one stays.  A document without an id stays only where no other of its group has one.
    """
    rows, names = plain(docs)
    rows = rows.withColumn("key", key_of(names))
    groups = jaccard.similar_documents(rows, words=5, percent=80, id_col="key", text_col=names["text"])
    groups = groups.select("key", F.col("component_id").alias("component"))
    known = rows.select("key", F.col(names["doc_id"]).alias("id")).groupBy("key").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.distinct().join(known, "key"), "groups")
    heads = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("head"))
    told = groups.join(heads, "component").select("key", (F.col("key") != F.col("head.key")).alias("goes"), "n")
    told = stored(told.filter("goes or n > 1"), "told")
    # most documents are in no group, and a table of bits knows that without a shuffle of their texts
    may = possible(rows, "key", told)
    looked = rows.filter(may).join(told, "key", "left")
    once = looked.filter("not coalesce(goes, false)")
    every = [*names.values()]
    single = once.filter("coalesce(n, 1) = 1").select(*every)
    several = once.filter("n > 1").groupBy("key").agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("row")).select("row.*")
    return named(rows.filter(~may).select(*every).unionByName(single).unionByName(several), names, docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold half of a benchmark item or more go."""
    rows, names = plain(docs)
    rows = rows.withColumn("key", key_of(names))
    leaks = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key", text_col=names["text"])
    leaks = stored(leaks.select("key").distinct(), "leaks")
    may = possible(rows, "key", leaks)
    kept = rows.filter(may).join(leaks, "key", "left_anti").unionByName(rows.filter(~may))
    return named(kept, names, docs)


def remove_personal_data(spark, docs, sf_dir):
    """Personal data, and terms that give it away, are replaced in the texts; all documents stay."""
    rows, names = plain(docs)
    clean = pii.sanitise(rows, id_col=names["doc_id"], text_col=names["text"])
    changed = {"text": F.col("clean_text")}
    if "n_chars" in names:
        changed["n_chars"] = F.length("clean_text")
    return named(clean, names, docs, **changed)


def pack(spark, docs, sf_dir):
    """Sequences of 1024 tokens: one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("packing", pack),
]

# n-gram ranks, alignments and BPE are beyond SQL; tests/llm compares the rows with a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
