"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: A source's weight over the course of training: (progress, relative weight) from 0 to 1, straight lines between.
SCHEDULE = ((0.0, 1.0), (1.0, 1.0))


def token_counts(docs: DataFrame, *, doc_id: str, text: str, keep: Sequence[Column] = (), vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ``keep``, tokens): whole texts in tokens of a public byte-level BPE. A null text has 0 tokens.

    The vocabulary, 50,256 entries, is read on the driver and sent along with the function.
    """
    from public_tokenizers import PATTERN

    with open(os.path.join(folder, vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(F.col(doc_id), *keep, F.col(text).alias("_text"))
    schema = source.drop("_text").withColumn("tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            counts = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(counts, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def _progress(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Progress at which the schedule's integral reaches ``share`` of its whole."""
    pieces, done = [], 0.0
    for (x0, w0), (x1, w1) in zip(schedule, schedule[1:]):
        pieces.append((x0, x1, w0, w1, done))
        done += (w0 + w1) / 2 * (x1 - x0)
    need = share * done
    out = None
    for x0, x1, w0, w1, before in reversed(pieces):
        slope, rest = (w1 - w0) / (x1 - x0), need - before
        # w0 * u + slope * u ** 2 / 2 = rest, in the form that does not cancel
        u = 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))))
        x = x0 + F.least(F.greatest(u, F.lit(0.0)), F.lit(x1 - x0))
        out = x if out is None else F.when(need <= before + (w0 + w1) / 2 * (x1 - x0), x).otherwise(out)
    return out


def _reached(progress: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Share of the schedule's whole integral reached at ``progress``."""
    out, whole = F.lit(0.0), sum((w0 + w1) / 2 * (x1 - x0) for (x0, w0), (x1, w1) in zip(schedule, schedule[1:]))
    for (x0, w0), (x1, w1) in zip(schedule, schedule[1:]):
        u = F.least(F.greatest(progress - x0, F.lit(0.0)), F.lit(x1 - x0))
        out = out + u * (w0 + (w1 - w0) / (x1 - x0) * u / 2)
    return out / whole


def check_schedule(schedule: Sequence[tuple[float, float]]) -> None:
    xs, ws = zip(*schedule)
    if xs[0] != 0 or xs[-1] != 1 or any(a >= b for a, b in zip(xs, xs[1:])) or min(ws) < 0 or all(w == 0 for w in ws):
        raise ValueError("a schedule runs from progress 0 to 1 in rising steps, with weights of 0 or more, not all 0")


def demand(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens asked of each source: the largest mix in which all sources present have their share under their caps.

    Sources without tokens cannot contribute; the others keep their proportions. A ``total`` beyond what caps allow is
    an error, as shares could then not hold.
    """
    there = {s: share for s, (share, _) in targets.items() if sizes.get(s, 0) > 0 and share > 0 and targets[s][1] > 0}
    if not there:
        return {}
    whole = sum(there.values())
    most = min(sizes[s] * targets[s][1] / (share / whole) for s, share in there.items())
    if total is not None and total > most * (1 + 1e-12):
        raise ValueError(f"{total} tokens asked, {most:.0f} possible under the caps")
    return {s: (total or most) * share / whole for s, share in there.items()}


def mix(
    sized: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str,
    source: str,
    tokens: str = "tokens",
    schedules: dict[str, Sequence[tuple[float, float]]] | None = None,
    total: int | None = None,
    seed: int = 17,
    buckets: int = 1024,
) -> DataFrame:
    """The mix: one row per use of a record (doc_id, source, copy, tokens, progress, position), range-sorted by position.

    ``targets`` (source, target_share, max_repeats) has a row per source: few, and read on the driver. A source's
    records come in a seeded random order, pass after pass; a use's place in its source's tokens is its share of the
    source's demand, and the inverse of the integrated schedule turns that into progress from 0 to 1. Its position is the
    number of tokens that all sources together demand up to that progress, so a unit of position is a token of the mix
    wherever it lies. A source without a schedule comes evenly in progress. The order within a source
    is cumulated inside hash buckets chained by their totals, so a source with a third of all rows is spread.
    Source names compare without case and blanks. Records with a null or unlisted source, or without tokens, take no
    part. Where a pass is cut, a record is used if at least half of it is asked. ``sized`` is read several times.
    """
    name = lambda c: F.lower(F.trim(c))
    rows = sized.select(F.col(doc_id).alias("_doc"), name(F.col(source)).alias("_source"), F.col(tokens).alias("_tokens")).where("_tokens > 0 AND _source IS NOT NULL AND _doc IS NOT NULL")
    limits = {r[0]: (r[1], r[2]) for r in targets.select(name(F.col("source")), "target_share", "max_repeats").collect()}
    rows = rows.where(F.col("_source").isin(list(limits)))
    sizes = {r[0]: r[1] for r in rows.groupBy("_source").agg(F.sum("_tokens")).collect()}
    need = demand(sizes, limits, total)
    for s in schedules or {}:
        check_schedule(schedules[s])
    order = F.xxhash64("_doc", F.lit(seed))
    rows = rows.where(F.col("_source").isin(list(need))).withColumn("_order", order).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_order", 40), F.lit(buckets)))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_source", "_bucket").agg(F.sum("_tokens").alias("_sum")).select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_doc").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_base") + F.sum("_tokens").over(inside) - F.col("_tokens") / 2

    def per_source(values: dict[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for s, v in values.items():
            out = F.when(F.col("_source") == s, F.lit(float(v))).otherwise(out)
        return out

    size, asked = per_source({s: sizes[s] for s in need}), per_source(need)
    placed = rows.join(bases, ["_source", "_bucket"]).withColumn("_middle", middle)
    passes = F.ceil((asked - F.col("_middle")) / size).cast("int")
    uses = placed.where(passes >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), passes)))
    share = (F.col("_middle") + (F.col("copy") - 1) * size) / asked
    progress, position = F.lit(None).cast("double"), F.lit(0.0)
    for s in need:
        schedule = (schedules or {}).get(s, SCHEDULE)
        progress = F.when(F.col("_source") == s, _progress(share, schedule)).otherwise(progress)
        position = position + F.lit(float(need[s])) * _reached(F.col("progress"), schedule)
    out = uses.select(F.col("_doc").alias(doc_id), F.col("_source").alias("source"), "copy", F.col("_tokens").alias("tokens"), progress.alias("progress"))
    out = out.withColumn("position", position)
    return out.repartitionByRange("position", doc_id, "copy").sortWithinPartitions("position", doc_id, "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: its target, the share of tokens reached, tokens, uses and the most uses of one record.

    A source without records has a share of 0; on an empty mix all shares are null.
    """
    name = F.lower(F.trim(F.col("source"))).alias("source")
    # copies are numbered from 1 in order, so a record's last copy is its number of uses
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("most_repeats"))
    listed = targets.select(name, "target_share", "max_repeats").join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    whole = F.sum("tokens").over(Window.partitionBy())  # over one row per source
    return listed.select("source", "target_share", "max_repeats", zero("tokens"), zero("uses"), zero("most_repeats"), F.try_divide(F.coalesce("tokens", F.lit(0)), whole).alias("reached_share"))
