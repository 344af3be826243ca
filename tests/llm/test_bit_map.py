"""The bits of asked ids come in one aggregate, not a job per partition."""

import numpy as np

from toponet.llm import neardup
from toponet.llm import words as W


def test_bit_map_holds_every_id_in_few_jobs(spark):
    ids = [*range(0, 3000, 7), -5, 1 << 62, -(1 << 63)]
    pairs = spark.createDataFrame([(x, y) for x, y in zip(ids, reversed(ids))], "a long, b long").repartition(16)
    context = spark.sparkContext
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    context.setJobGroup("bit-map", "bit-map")
    try:
        made = neardup._bit_map(pairs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(merging, before)
    bits = np.unpackbits(np.frombuffer(made, np.uint8), bitorder="little")
    wanted = W.mix(np.array(ids, np.int64).view(np.uint64)) % np.uint64(neardup.FILTER_BITS)
    assert len(bits) == neardup.FILTER_BITS and set(np.flatnonzero(bits)) == set(wanted.tolist())
    assert len(context.statusTracker().getJobIdsForGroup("bit-map")) <= 4
