"""Near rows are merged pair by pair in the order of their ids, as the method says, and not as clusters."""

import duckdb
import numpy as np
import pytest
from compare import compare
from helpers import vectors

from __spark_entry__ import oracle_sql, queries
from latentlake.operators import pairs


def plainly(m, d, amp, tau, reach):
    """{row: (amplitude, rows that ended in it)}: every pair in order, by direct distances."""
    amp, count = [complex(v) for v in amp], [1] * len(m)
    for i in range(len(m)):
        for j in range(i + 1, len(m)):
            if count[i] and count[j] and abs(d[i] - d[j]) < tau and np.sqrt(((m[i] - m[j]) ** 2).sum()) < reach:
                s, t = (i, j) if abs(amp[i]) >= abs(amp[j]) else (j, i)
                amp[s], count[s], count[t] = amp[s] - amp[t], count[s] + count[t], 0
    return {i: (amp[i], count[i]) for i in range(len(m)) if count[i]}


def table(spark, m, amp):
    d = np.sqrt((m ** 2).sum(1))
    return d, vectors(spark, m, g=["a"] * len(m), d=[float(v) for v in d], re=[float(v.real) for v in amp], im=[float(v.imag) for v in amp])


def test_a_chain_is_not_a_cluster(spark):
    """The first row takes the second and is then too weak for the third's; the fourth is linked to a row that has gone."""
    m, amp = np.array([[5.0, 0.0], [5.0, 0.1], [5.0, 0.2], [5.0, 0.3], [5.0, 9.0]]), np.array([3.0, 2.0, 2.5, 1.0, 1.0], complex)
    _, df = table(spark, m, amp)
    got = {r.vec_id: (r.re, r.merged) for r in pairs.merge_near(df, "g", "vec_id", "x", tau=0.1, reach=0.15).collect()}
    assert got == {0: (1.0, 2), 2: (1.5, 2), 4: (1.0, 1)}


@pytest.mark.parametrize("run_rows", [16_384, 17])
def test_pairs_in_order(spark, run_rows):
    """Copies, near copies and clusters, components in one task and in blocks of 17 rows."""
    rng = np.random.default_rng(8)
    m = rng.standard_normal((6, 5))[rng.integers(0, 6, 110)] + rng.standard_normal((110, 5)) * 0.15
    m[10:50:3] = m[10]
    m[60:64] = m[60]
    amp = rng.standard_normal(110) + 1j * rng.standard_normal(110)
    amp[10:50:3] = amp[10]
    d, df = table(spark, m, amp)
    want = plainly(m, d, amp, 0.2, 0.6)
    got = {r.vec_id: (complex(r.re, r.im), r.merged) for r in pairs.merge_near(df, "g", "vec_id", "x", tau=0.2, reach=0.6, run_rows=run_rows).collect()}
    assert got.keys() == want.keys() and 10 < len(want) < 100
    assert all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0], abs=1e-12) for i in want)


def test_query_on_near_copies_is_its_sql(spark, sf, tmp_path):
    """Half of the rows get a near copy, some several: rows merge, which the given table's don't."""
    con = duckdb.connect()
    con.execute(f"""CREATE TABLE embeddings AS WITH o AS (SELECT * FROM '{sf}/embeddings.parquet' WHERE vec_id < 120)
        SELECT * REPLACE (vec_id * 7 + k AS vec_id, list_transform(embedding, lambda v, i: (v * (1 + 0.002 * k * (i % 3)))::FLOAT)::FLOAT[] AS embedding)
        FROM o, unnest(range(5)) t(k) WHERE k = 0 OR vec_id % (k * 2) = 0""")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    df = queries()["i4_merge_near"](spark, str(tmp_path))
    assert compare(df, con, oracle_sql()["i4_merge_near"]) is None
    assert df.where("merged > 1").count() > 20 and df.where("merged > 2").count() > 0
