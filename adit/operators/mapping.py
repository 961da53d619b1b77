"""Records to techniques: over their weaknesses, from the words of their descriptions, and both together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adit.functions.identifiers import weakness_id
from adit.functions.texts import phrase_techniques
from adit.runtime import BROADCAST_ROWS, small_enough

_STRINGS = "array<string>"
#: What a method is called in results.
BY_WEAKNESS, BY_WORDS, BY_LIKENESS = "weakness", "keyword", "likeness"


def weaknesses_of(record: Column) -> Column:
    """The weaknesses of a record (VARIANT) in whichever layout: a field cwe_ids (a text or a list), the list weaknesses of
    the 2.0 dialect, or the problemtype of the 1.1 dialect; normalised, each once, sorted."""
    got = lambda path, kind: F.try_variant_get(record, path, kind)
    none = F.array().cast(_STRINGS)
    direct = F.coalesce(got("$.cwe_ids", _STRINGS), F.array(got("$.cwe_ids", "string")))
    texts = lambda items: F.flatten(F.transform(items, lambda w: F.coalesce(F.transform(F.try_variant_get(w, "$.description", "array<variant>"), lambda x: F.try_variant_get(x, "$.value", "string")), none)))
    second = F.coalesce(texts(got("$.weaknesses", "array<variant>")), none)
    first = F.coalesce(texts(F.coalesce(got("$.problemtype.problemtype_data", "array<variant>"), got("$.cve.problemtype.problemtype_data", "array<variant>"))), none)
    every = F.transform(F.array_compact(F.concat(direct, second, first)), weakness_id)
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def by_weakness(records: DataFrame, key: str, weaknesses: str, mapping: DataFrame) -> DataFrame:
    """key, techniques (sorted, each once) and mappings (array of weakness, capecs, techniques) of records with any.

    mapping: weakness, capecs, mitre_techniques, one row per weakness. Weaknesses are taken in any spelling; those without
    techniques are no mapping.
    """
    items = records.select(key, F.explode(F.array_distinct(F.array_compact(F.transform(weaknesses, weakness_id)))).alias("weakness"))
    known = mapping.filter(F.size("mitre_techniques") > 0).select("weakness", "capecs", "mitre_techniques")
    found = items.join(F.broadcast(known) if small_enough(known) else known, "weakness")
    # A record's own weaknesses are few: what is nested here is bounded by its list.
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("weakness", "capecs", F.col("mitre_techniques").alias("techniques")))).alias("mappings"))
    techniques = F.array_sort(F.array_distinct(F.flatten(F.transform("mappings", lambda m: m["techniques"]))))
    return rows.select(key, techniques.alias("techniques"), "mappings")


def likeness(factors: DataFrame, observed: DataFrame, threshold: float, most: int = 10) -> DataFrame:
    """For each set of observed techniques, what is most like the mean of their vectors: observed, n_known, inferred
    (array of technique, confidence, at most `most`, best first, ties by technique).

    factors: technique_id, embedding, one row each; they go to every task and are counted first. observed: the sets, an
    array column, each once. The confidence is the cosine, a length of 0 counting as 1e-8; it must exceed the threshold,
    and what is observed isn't inferred. A set without a known technique has none.
    """
    if not small_enough(factors, BROADCAST_ROWS):
        raise ValueError(f"more than {BROADCAST_ROWS} techniques; infer with parts of them")
    rows = factors.orderBy("technique_id").collect()
    names = [r.technique_id for r in rows]
    vectors = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)
    lengths = np.linalg.norm(vectors, axis=1)
    shared = factors.sparkSession.sparkContext.broadcast((names, {n: i for i, n in enumerate(names)}, vectors, np.where(lengths == 0, 1e-8, lengths)))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place, vectors, lengths = shared.value
        for batch in batches:
            counts, inferred = [], []
            for seen in batch.column(0).to_pylist():
                own = [place[t] for t in seen if t in place]
                counts.append(len(own))
                if not own:
                    inferred.append([])
                    continue
                mean = vectors[own].mean(axis=0)
                c = vectors @ mean / (lengths * max(np.linalg.norm(mean), 1e-8))
                c[own] = -2
                best = [i for i in np.lexsort((np.arange(len(c)), -np.round(c, 12))) if c[i] > threshold and c[i] > -2][:most]
                inferred.append([{"technique": names[i], "confidence": float(c[i])} for i in best])
            kind = pa.list_(pa.struct([("technique", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(inferred, kind)], ["observed", "n_known", "inferred"])

    return observed.select("observed").mapInArrow(infer, "observed array<string>, n_known int, inferred array<struct<technique:string,confidence:double>>")


def by_description(records: DataFrame, key: str, text: str, factors: DataFrame | None, threshold: float = 0.1, most: int = 10) -> DataFrame:
    """key, method, techniques (those of the words first, then inferred ones) and inferred, for records with a text.

    The words' techniques are the observed ones. Without any there is nothing to infer from; without factors, or if no
    observed technique has one, they are all there is. As many records share a set, each set is looked at once.
    """
    rows = records.filter(F.col(text) != "").select(key, phrase_techniques(F.col(text)).alias("observed"))
    none = F.array().cast("array<struct<technique:string,confidence:double>>")
    if factors is None:
        return rows.select(key, F.lit(BY_WORDS).alias("method"), F.col("observed").alias("techniques"), none.alias("inferred"))
    sets = likeness(factors, rows.select("observed").distinct().filter(F.size("observed") > 0), threshold, most)
    both = rows.join(F.broadcast(sets) if small_enough(sets) else sets, "observed", "left")
    method = F.when(F.size("observed") == 0, BY_LIKENESS).when(F.col("n_known") == 0, BY_WORDS).otherwise(BY_LIKENESS)
    inferred = F.coalesce("inferred", none)
    return both.select(key, method.alias("method"), F.concat("observed", F.transform(inferred, lambda x: x["technique"])).alias("techniques"), inferred.alias("inferred"))


def combined(records: DataFrame, key: str, weaknesses: str, text: str, mapping: DataFrame, factors: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """Every record with the techniques of its weaknesses, then those of its description that are new, each once:
    key, techniques, methods and n_techniques."""
    a = by_weakness(records, key, weaknesses, mapping).select(key, F.col("techniques").alias("mapped"))
    b = by_description(records, key, text, factors, threshold).select(key, F.col("techniques").alias("told"))
    both = records.select(key).join(a, key, "left").join(b, key, "left")
    none = F.array().cast(_STRINGS)
    mapped, new = F.coalesce("mapped", none), F.array_except(F.coalesce("told", none), F.coalesce("mapped", none))
    methods = F.concat(F.when(F.size(mapped) > 0, F.array(F.lit(BY_WEAKNESS))).otherwise(none), F.when(F.size(new) > 0, F.array(F.lit(BY_LIKENESS))).otherwise(none))
    techniques = F.array_distinct(F.concat(mapped, new))
    return both.select(key, techniques.alias("techniques"), methods.alias("methods"), F.size(techniques).alias("n_techniques"))


def mapping_summary(results: DataFrame) -> DataFrame:
    """n_records, n_mapped and n_techniques (different ones) of combined(), as one row."""
    rows = results.select(F.struct(F.lit(1).alias("one"), (F.size("techniques") > 0).cast("int").alias("mapped")).alias("r"), "techniques")
    totals = rows.agg(F.sum("r.one").alias("n_records"), F.sum("r.mapped").alias("n_mapped"), F.lit(None).cast("bigint").alias("n_techniques"))
    kinds = rows.select(F.explode("techniques").alias("t")).agg(F.lit(None).cast("bigint").alias("n_records"), F.lit(None).cast("bigint").alias("n_mapped"), F.countDistinct("t").alias("n_techniques"))
    return totals.unionByName(kinds).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_records", "n_mapped", "n_techniques")])


def point_lookup(mapping: DataFrame, weakness: str) -> DataFrame:
    """The patterns and techniques of one weakness, in any spelling: weakness, capecs, mitre_techniques."""
    return mapping.filter(F.col("weakness") == weakness_id(F.lit(weakness)))
