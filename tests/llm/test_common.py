import numpy as np
import pytest
from pyspark.sql import functions as F

from clickweave.llm import common
from clickweave.llm.common import Scratch, add_pieces, scratch_path, sum_vectors, vector_pieces


@pytest.mark.parametrize(("partitions", "fan_in"), [(1, 32), (7, 2), (40, 3)])
def test_vectors_are_summed_in_levels(spark, partitions, fan_in):
    def fill(batches):
        sums = np.zeros(1000, np.int64)
        for batch in batches:
            np.add.at(sums, batch.column("id").to_numpy() % 997, 1)
        return sums

    df = spark.range(0, 5000, 1, partitions)
    expected = np.bincount(np.arange(5000) % 997, minlength=1000)
    assert (sum_vectors(df, fill, 1000) == expected).all()
    rows = [(k, data) for part in range(partitions) for k, data in vector_pieces(np.bincount(np.arange(part, 5000, partitions) % 997, minlength=1000), 32)]
    parts = Scratch(spark).save(spark.createDataFrame(rows, "piece int, data binary"), "parts")
    assert (add_pieces(parts, 1000, fan_in=fan_in) == expected).all()
    assert (add_pieces(parts.filter(F.lit(False)), 1000) == 0).all()


def test_scratch_is_shared_or_refused(spark, monkeypatch):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(Session())
