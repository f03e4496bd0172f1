"""The approximate search against the exact scan, for every query whose id 50 divides."""

import numpy as np
import pytest

from tidewake import catalog


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_cells_keep_nine_of_ten_neighbours(spark, name):
    sf = f"/root/testdata/{name}"
    celled, centres = catalog.celled(spark, sf)
    rows = celled.orderBy("vec_id").collect()
    ids, cell = np.array([r["vec_id"] for r in rows]), np.array([r["cell"] for r in rows])
    v = np.array([r["embedding"] for r in rows], float)
    recall = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = v @ v[i]
        best = np.lexsort((ids, -score))[:10]
        probed = np.isin(cell, np.argsort(-(np.array(centres) @ v[i]), kind="stable")[: catalog.PROBES])
        recall.append(probed[best].mean())
        if ids[i] == 0:
            kept = np.flatnonzero(probed)
            want = ids[kept[np.lexsort((ids[kept], -score[kept]))[:10]]].tolist()
            assert [r["vec_id"] for r in catalog.knn_cells(spark, sf).collect()] == want
    print(name, "recall", np.mean(recall), "registered query", recall[0])
    assert np.mean(recall) >= 0.9
