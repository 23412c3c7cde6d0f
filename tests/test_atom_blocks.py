"""Dense cubes of atoms are dealt to blocks and to all tasks, with no pair lost or made twice."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandworks.operators import screen as sc

LIGAND, RECEPTOR = "mol int, x double, y double, z double, atype string", "res string, x double, y double, z double, atype string"


@pytest.fixture(scope="module")
def cloud(spark):
    """Most atoms in one cube, some about it, some twice, some without a place."""
    r = random.Random(11)
    at = lambda a, b: [round(r.uniform(a, b), 3) for _ in range(3)]
    lig = [(i % 10, *at(0.1, 3.9), "NC"[i % 2]) for i in range(300)] + [(i % 10, *at(-9, 9), "N") for i in range(60)]
    rec = [(f"R{i % 7}", *at(0.1, 3.9), "OC"[i % 2]) for i in range(400)] + [(f"R{i % 7}", *at(-9, 9), "O") for i in range(80)]
    lig, rec = lig + lig[:5] * 3, rec + rec[:5] * 3
    lost = (None, 1.0, 1.0)
    return lig, rec, spark.createDataFrame([*lig, (1, *lost, "N")], LIGAND), spark.createDataFrame([*rec, ("R1", *lost, "O")], RECEPTOR)


def test_pairs_of_dealt_cubes_are_whole(cloud):
    lig, rec, ligands, receptor = cloud
    want = Counter((a[0], a[4], b[0], b[4], round(math.dist(a[1:4], b[1:4]), 9)) for a in lig for b in rec if math.dist(a[1:4], b[1:4]) < 4)
    for block in (7, 64, sc.BLOCK):
        assert Counter((x.mol, x.ltype, x.res, x.atype, round(x.d, 9)) for x in sc.atom_pairs(ligands, receptor, block=block).collect()) == want


def test_no_block_holds_a_dense_cube(cloud):
    _, _, ligands, receptor = cloud
    for side in sc.dealt_atoms(ligands, receptor, sc.CONTACT, 64):
        by = side.where("cx is not null").groupBy("cx", "cy", "cz", "lblock", "rblock").count().collect()
        assert max(x["count"] for x in by) <= 2 * 64
        assert len({(x.lblock, x.rblock) for x in by if (x.cx, x.cy, x.cz) == (0, 0, 0)}) >= 5 * 6


def test_few_bytes_of_many_pairs_go_to_all_tasks(spark, cloud):
    _, _, ligands, receptor = cloud
    pairs = sc.atom_pairs(ligands, receptor, block=64)
    by = [x["count"] for x in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(by) < 0.5 * sum(by)


def test_pairs_of_a_registered_query_are_not_made_by_one_task(spark):
    from strandworks.plans import registry

    pairs = registry.queries()["j5_atom_pairs"](spark, "/root/testdata/sf0.1")
    by = [x["count"] for x in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by) == 246058 and len(by) > 1
