"""Task functions must load where this package is not installed."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from wayfold.functions import vectors
from wayfold.operators import batches, snapshots


@pytest.mark.parametrize("function", [snapshots._dom_nodes, snapshots._inflate, batches._call, vectors._distances])
def test_functions_carry_their_code(function):
    code = "import pickle, sys; print(callable(pickle.loads(sys.stdin.buffer.read())), 'wayfold' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(function), capture_output=True, cwd="/", timeout=120)
    assert done.stdout.decode().split() == ["True", "False"], done.stderr.decode()


def test_a_cluster_without_a_shared_folder_is_refused():
    from wayfold.session import shared_folder

    class Conf(dict):
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_folder(Session())
