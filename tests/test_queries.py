"""Every registered query against its SQL in DuckDB, row for row, and that all run over whole tables."""

import math
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tidewake.plans import scoring
from tidewake.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__module__ == "decimal":
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


# Queries without SQL: each against values that are worked out another way.


def frame(spark, name, data=DATA):
    return QUERIES[name](spark, data).toPandas()


def text_of(spark, data=DATA):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_a14(spark):
    got = frame(spark, "a14_embed_missing").set_index("post_id")
    have = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    texts = text_of(spark)
    assert set(got.index) == set(texts) - have and (got.width == 384).all()
    assert all(abs(got.norm[i] - (1 if texts[i].split() else 0)) < 0.002 for i in got.index)


def test_f05(spark):
    seen, exact, want = [], set(), []
    for i, t in sorted(text_of(spark).items()):
        label = t.split("\n")[0]
        low = label.strip(" ").lower()
        if low in exact:
            continue
        exact.add(low)
        words = {w for w in label.lower().split() if len(w) > 3}
        if len(words) > 4:
            if any(len(words & s) / len(words | s) >= 0.65 for s in seen):
                continue
            seen.append(words)
        want.append(i)
        if len(want) == 50:
            break
    assert frame(spark, "f05_label_dedup").doc_id.tolist() == want


@pytest.mark.parametrize(("name", "key", "size"), [("k01_style", "source", 32), ("k02_cadence", "user_id", 16), ("k03_network", "cluster_id", 12), ("k04_entity_bias", "cluster_id", 24)])
def test_parts_of_fingerprints(spark, name, key, size):
    got = frame(spark, name)
    assert len(got) and got.x.notna().all()
    for _, g in got.groupby(key):
        assert sorted(g.i) == list(range(size)) and min(abs((g.x**2).sum() - n) for n in (0, 1)) < 0.01
    assert got.x.abs().max() > 0.3


def test_k01_against_python(spark):
    from tidewake.functions import fixed_values as fixed

    texts = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect():
        texts.setdefault(r.source, []).append(r.text)
    got = frame(spark, "k01_style")
    for source, g in got.groupby("source"):
        words = [w for t in texts[source] for w in re.findall(r"\b[a-zA-Z]+\b", t.lower())]
        x = g.sort_values("i").x.to_numpy()
        if len(words) < 100:
            assert not x.any()
            continue
        want = np.array([words.count(w) / len(words) for w in fixed.FUNCTION_WORDS[:20]] + [len(set(words)) / len(words)])
        mine = np.append(x[:20], x[23])
        assert np.allclose(mine / np.linalg.norm(mine), want / np.linalg.norm(want), atol=2e-3)


def test_k06_and_k07(spark):
    prints = {r.cluster_id: r for r in scoring._fingerprints(spark, DATA).collect()}
    cos = lambda a, b: 0.0 if min(np.linalg.norm(a), np.linalg.norm(b)) < 1e-10 else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    whole, parts = {}, {}
    for a in prints:
        for b in prints:
            if a < b:
                whole[a, b] = cos(prints[a].fingerprint, prints[b].fingerprint)
                parts[a, b] = [cos(prints[a][p], prints[b][p]) for p in ("style", "cadence", "network", "entity")]
    got = {(r.a, r.b): r.score for r in frame(spark, "k07_fingerprint_matches").itertuples()}
    assert set(got) == {p for p, c in whole.items() if c >= 0.5} and all(abs(got[p] - whole[p]) < 1e-3 for p in got)
    k06 = frame(spark, "k06_pair_scores")
    assert {(r.a, r.b) for r in k06.itertuples()} == {p for p, c in whole.items() if c >= 0.01}
    for r in k06.itertuples():
        score = float(np.dot(parts[r.a, r.b], [0.3, 0.3, 0.2, 0.2]))
        assert abs(r.score - score) < 1e-3 and (r.confidence == "high") == (r.score >= 0.85) and (r.confidence == "low") == (r.score < 0.75)


def test_j02(spark):
    from tidewake.operators.clustering import RESOLUTIONS, density_labels

    rows = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-10)[:, None]
    got = {}
    for r in QUERIES["j02_density_clusters"](spark, DATA.replace("0.001", "0.01")).collect():
        got.setdefault(r.resolution, {})[r.vec_id] = r.cluster
    for size, name in RESOLUTIONS.items():
        labels = density_labels(x, size)
        want = {rows[k].vec_id: labels[k] for k in range(len(rows)) if labels[k] >= 0}
        mine = got.get(name, {})
        assert set(mine) == set(want) and len({(mine[i], want[i]) for i in want}) == len(set(mine.values())) == len(set(want.values()))


def test_j01(spark):
    """The clusters are those of the reduced rows, which keep neighbourhoods better than chance does."""
    from tidewake.operators.clustering import RESOLUTIONS, density_labels
    from tidewake.operators.reduction import reduce

    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = reduce(e, "vec_id", "embedding").orderBy("vec_id").collect()
    y = np.array([r.reduced for r in rows])
    u = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    assert y.shape == (len(u), 5)
    near = [set(np.argsort(d)[1:11]) for d in np.linalg.norm(y[:, None] - y, axis=2)]
    true = [set(np.argsort(-c)[1:11]) for c in u @ u.T]
    assert np.mean([len(a & b) / 10 for a, b in zip(near, true)]) > 3 * 10 / len(u)
    got = {}
    for r in QUERIES["j01_reduced_clusters"](spark, DATA).collect():
        got.setdefault(r.resolution, {})[r.vec_id] = r.cluster
    for size, name in RESOLUTIONS.items():
        labels = density_labels(y, size)
        want = {rows[k].vec_id: labels[k] for k in range(len(rows)) if labels[k] >= 0}
        mine = got.get(name, {})
        assert set(mine) == set(want) and len({(mine[i], want[i]) for i in want}) == len(set(want.values()))


def test_l04_l05_l08(spark):
    from tidewake.operators import graph

    edges = frame(spark, "l02_ego_edges", DATA.replace("0.001", "0.01"))
    got = frame(spark, "l04_paths_l05_small_world_l08_centrality", DATA.replace("0.001", "0.01")).set_index("cluster_id")
    assert len(got) == edges.cluster_id.nunique() > 0
    for c, g in edges.groupby("cluster_id"):
        src, dst = g.src.to_numpy(str), g.dst.to_numpy(str)
        near = {}
        for a, b in zip(src, dst):
            near.setdefault(a, set()).add(b)
        lengths = []
        for s in set(src) | set(dst):
            far, todo = {s: 0}, [s]
            for x in todo:
                for y in near.get(x, ()):
                    if y not in far:
                        far[y] = far[x] + 1
                        todo.append(y)
            lengths += [d for y, d in far.items() if y != s]
        assert abs(got.path_length[c] - np.mean(lengths)) < 1e-9 and got.diameter[c] == max(lengths)
        assert got.small_world[c] == graph.path_metrics(src, dst)["small_world"]


def test_p12(spark):
    n = {r.stage: r.n for r in QUERIES["p12_whole_cycle"](spark, DATA).collect()}
    assert n["posts"] == n["vectors"] > n["members"] == n["posts_of_groups"] > 0
    assert n["scores"] == n["phases"] == n["fingerprints"] > 0 and n["credibility"] > 0


def test_every_query_without_sql_has_a_test():
    assert set(QUERIES) - set(ORACLES) == {"a14_embed_missing", "f05_label_dedup", "j01_reduced_clusters", "k01_style", "k02_cadence", "k03_network", "k04_entity_bias", "k06_pair_scores", "k07_fingerprint_matches", "j02_density_clusters", "l04_paths_l05_small_world_l08_centrality", "p12_whole_cycle"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_rows(name):
    """Two empty results would prove nothing."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA.replace('0.001', '0.01')}/{t}.parquet'")
    assert con.sql(f"SELECT count(*) FROM ({ORACLES[name]})").fetchall()[0][0] > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "score" in df.columns


def test_no_sql_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_s03_makes_no_links_of_purged_groups(spark, monkeypatch):
    from tidewake.operators import vectors

    seen, made = [], vectors.similar_pairs
    monkeypatch.setattr(vectors, "similar_pairs", lambda df, *more: seen.append(df.count()) or made(df, *more))
    d = DATA.replace("0.001", "0.01")
    QUERIES["s03_purge"](spark, d)
    assert len(seen) == 1 and 0 < seen[0] < spark.read.parquet(f"{d}/embeddings.parquet").count()
