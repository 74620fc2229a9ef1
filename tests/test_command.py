import random

import pytest

from tessera.__main__ import main
from tessera.functions.workload import attribute_points
from tessera.sources.records import write_records


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("set")
    rng = random.Random(1)
    for name, n in (("base", 300), ("query", 5)):
        rows = [(i, [rng.random() for _ in range(4)]) for i in range(n)]
        write_records(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), f"{folder}/toy_{name}.fvecs", "fvecs", "vec_id", "embedding", 4)
    write_records(attribute_points(spark, "uniform", 300, 2), f"{folder}/toy_metadata_uniform_2d.bin", "attributes", "vec_id", ["m0", "m1"], 2)
    return str(folder)


@pytest.mark.parametrize("shape, index", [("box", "cubes"), ("ball", "rtree"), ("polygon", "kdtree"), ("shell", "cubes")])
def test_searches_are_exact(files, tmp_path, shape, index):
    out = main(["-s", files, "-d", "toy", "-f", "0.3", "--shape", shape, "--index", index, "-k", "5", "--log", str(tmp_path / "log"), "-l", "50"])
    assert out[0][:2] == (5, 1.0) and out[0][3] == 1.0
