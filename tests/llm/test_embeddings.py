"""Int8 tile products against plain double precision."""

import numpy as np
import pytest

from cohortspark.llm import embeddings


def brute(rows, threshold=0.93):
    ok = []
    for i, (_, x, label) in enumerate(rows):
        good = label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)
        if good:
            ok.append(i)
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i].add(j)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((row[0], len(links[i]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [16, 1024])
def test_pairs(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(150):
        x = centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.4])
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(2)) if i % 20 else None))
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(20)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [1.0, 2.0], 1), (304, [], 1)]
    rows += [(305, [None] + [1.0] * 15, 1), (306, [float("inf")] * 16, 1), (None, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    # Columns that are not read, one of them with a name of the operator's own.
    vectors = spark.createDataFrame([(*r, "x" * 1000, 7) for r in rows], "vec_id long, embedding array<float>, label int, node string, copies int")
    got = embeddings.near_duplicates(vectors, tile=tile).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows)
    assert embeddings.near_duplicates(vectors.limit(0)).collect() == []


@pytest.mark.parametrize("size", [64, 1536, 4096])
def test_close_to_the_threshold(spark, size):
    """Pairs within the bounds, with large codes in every dimension: only full precision can tell."""
    rng = np.random.default_rng(size)
    rows = []
    for i in range(12):
        x = rng.choice([-1.0, 1.0], size) * rng.uniform(0.9, 1, size)
        y = rng.normal(size=size)
        x, y = x / np.linalg.norm(x), y - x * (x @ y) / (x @ x)
        y /= np.linalg.norm(y)
        for k, d in enumerate((-1e-3, -1e-7, 1e-7, 1e-3)):
            c = 0.93 + d
            rows.append((10 * i + k, [*map(float, c * x + np.sqrt(1 - c * c) * y)], i % 2))
        rows.append((10 * i + 9, [*map(float, x)], i % 2))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embeddings.near_duplicates(vectors, tile=20).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows)


def test_products_are_exact():
    """Sums of products of codes beyond what a 32-bit float holds."""
    rng = np.random.default_rng(4)
    x = rng.choice([-127, 127, 126], (40, 5000)).astype(np.int8)
    ones, none = np.ones(40), np.zeros(40)
    tile = embeddings.Tile(x.tobytes(), np.stack([ones, none, none]).tobytes(), 5000)
    want = x.astype(int) @ x.astype(int).T
    for at in np.unique(want)[::50]:
        linked, unsure = embeddings.products(tile, tile, slice(0, 40), float(at))
        assert (linked | unsure == (want >= at)).all()


def test_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24)) * rng.choice([1e-3, 1, 1e3], size=(200, 1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes, scales, norms, errors = embeddings.quantised(unit)
    near = (codes.astype(int) @ codes.astype(int).T) * np.outer(scales, scales)
    bound = np.outer(errors, norms) + np.outer(norms, errors) + np.outer(errors, errors)
    assert (np.abs(near - unit @ unit.T) <= bound + 1e-12).all()
