"""Cases that earlier versions got wrong: index invariants and routing, tallies, spans without caps, roles of edits."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.llm import chat, mixing, pii, simhash, topk
from tactus.llm.components import stars


def test_levels_are_nets():
    points = np.random.default_rng(1).normal(size=(900, 3)) * 100
    levels = topk.nets(points, 400)
    for (radius, centres, nearest), (below, more, _) in zip(levels, levels[1:]):
        gaps = np.linalg.norm(points[centres][:, None] - points[centres][None], axis=2)[~np.eye(len(centres), dtype=bool)]
        assert len(gaps) == 0 or gaps.min() > radius
        assert np.linalg.norm(points - points[centres][nearest], axis=1).max() <= radius
        assert below <= radius / 2 or len(more) == 400
        assert (more[: len(centres)] == centres).all()  # nested


def test_nodes_cover_their_members():
    points = np.random.default_rng(2).normal(size=(2000, 4))

    def walk(node):
        assert np.linalg.norm(points[node.members] - node.centre, axis=1).max() <= node.radius + 1e-12
        if node.children:
            assert sorted(node.members) == sorted(np.concatenate([c.members for c in node.children]))
        return 1 + max([walk(c) for c in node.children], default=0)

    tree = topk.cover_tree(points)
    assert sorted(tree.members) == list(range(2000)) and walk(tree) > 2


def brute(rows, k, every):
    out = []
    for q, u in rows:
        if q % every == 0:
            limit = topk.LIMIT
            scores = [(-max(-limit, min(limit, sum(int(a) * int(b) for a, b in zip(u, v)))), x) for x, v in rows if x != q and len(u) == len(v)]
            out += [(q, i + 1, x, -s) for i, (s, x) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("shape", ["clusters", "huge"])
def test_routing_is_exact(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "PART", 60)
    rng = np.random.default_rng(3)
    if shape == "clusters":
        base = rng.normal(size=(12, 6)) * 500
        rows = [(i, np.floor(base[i % 12] + rng.normal(size=6) * 20).tolist()) for i in range(900)]
    else:
        rows = [(i, [float(x) * 1e10 * 256 for x in rng.integers(-3, 4, 5)] if i % 3 else [1.0, 2.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = topk.top_k(df, df.where("vec_id % 10 = 0")).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 5, 10)


def test_queries_go_where_bounds_allow():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 8)) * 1000
    points = [base[i % 20] + rng.normal(size=8) for i in range(2000)]
    top = topk.Centres(points, 20)
    home, away = top.home(points)
    top.dealt([{"home": h, "n": int((home == h).sum()), "away": float(away[home == h].max())} for h in range(20)])
    sent = 0
    for i in range(0, 2000, 50):
        scores = np.array(points) @ points[i]
        own = np.sort(scores[home == home[i]])[-6]
        to = top.reached(points[i], own, home[i])
        sent += len(to)
        assert all(home[j] in (*to, home[i]) for j in np.flatnonzero(scores >= own))
    assert sent < 0.5 * 40 * 19  # not all to all


def test_components_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e10, 1e10]), (1, [1e10, 1e10]), (2, [-1e10, 1.0]), (3, [3e300, 1.0]), (4, [1e308, 1.0])], "vec_id long, embedding array<double>")
    rows = topk.scaled(df)
    assert sorted(r["vec_id"] for r in rows.collect()) == [0, 1, 2, 3]  # the last is not finite after scaling
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(rows, rows.where("vec_id = 0")).collect()}
    assert got == {(0, 1): topk.LIMIT, (0, 2): -topk.LIMIT, (0, 3): topk.LIMIT}


def test_blocks_meet_every_tally():
    for c in simhash.LISTS:  # any five shared positions hold a block
        assert any(set(b) <= set(c) for b in simhash.BLOCKS)


@pytest.mark.parametrize("long", [4096, 20])
def test_long_lists_lose_no_links(spark, monkeypatch, long):
    monkeypatch.setattr(simhash, "LONG", long)
    rng, prints = np.random.default_rng(6), set()
    for _ in range(8):
        base = int(rng.integers(0, 2**62))
        for _ in range(150):
            x = base
            for _ in range(int(rng.integers(0, 7))):
                x ^= 1 << int(rng.integers(0, 63))
            prints.add(x)
    every = np.array(sorted(prints))
    near = [(int(every[i]), int(every[j])) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count((every ^ every[i]).view(np.uint64)) <= 3) if i < j]
    star = {r["b"]: r["a"] for r in stars(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))).collect()}
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: star.get(x, x) for x in prints} == {x: root(x) for x in prints}


@pytest.mark.parametrize(
    "text, want",
    [
        ("a" * 100 + " [at] example [dot] com", "<EMAIL>"),
        ("x" * 50 + "://u:p@localhost:80/a b", "<URL> b"),
        ("see https://host.org/a?id=3&email=x%40y.org, ok", "see <URL>, ok"),
        ("see https://host.org/page?id=3 ok", "see https://host.org/page?id=3 ok"),
        ("Api Key: abcdefghij and password: hunterpass", "Api Key: <ACCOUNT> and password: <ACCOUNT>"),
    ],
)
def test_pii_without_caps(text, want):
    assert pii.masked(text) == want


def test_pii_counts_are_of_base_spans(spark):
    rows = [(1, "mailto:me@localhost a@b.org"), (2, "john [at] example [dot] com tel:555-123-4567"), (3, None), (4, "ip 1.2.3.4 a@b.org a@b.org " * 40_000)]
    got = {r["doc_id"]: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["n_email"], got[i]["n_phone"], got[i]["n_ip"]) for i in (1, 2, 3, 4)] == [(1, 0, 0), (0, 0, 0), (0, 0, 0), (80_000, 0, 40_000)]
    assert got[1]["spans"] == "email:7:19,email:20:27" and got[2]["spans"] == "email:0:27,phone:32:44" and got[3]["spans"] == ""


def test_pii_is_linear_in_long_runs():
    for text in ("a" * 2_000_000, "[at]" * 200_000, "1." * 500_000, "a@" * 500_000, "x://" * 300_000, " at a" * 300_000):
        pii.finder().spans(text)


def test_edits_keep_the_role(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 0, 5, "edit", None, "hello"), (1, 1, 1, "message", "assistant", "x"),
        (1, 1, 2, "regenerate", None, "a"), (1, 1, 3, "delta", None, "b"), (1, 2, 9, "edit", None, "no role at all"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, event string, role string, text string")
    out = chat.read_back(chat.render(chat.fold(df))).orderBy("place").collect()
    assert [(r["role"], r["text"], r["loss"]) for r in out] == [("user", "hello", False), ("assistant", "ab", True), ("", "no role at all", False)]


def test_mixing_moves_no_texts(spark, sf_dir):
    plan = mixing.op8_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(line for line in plan.splitlines() if "Exchange" in line or "Sort" in line)


@pytest.mark.parametrize("op", ["quality", "simhash", "pii"])
def test_megabytes_of_text(spark, op):
    from tactus.llm import quality

    rows = [(1, "word and more words here \n" * 120_000), (2, "y" * 3_000_000), (3, "é, " * 700_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    if op == "quality":
        assert quality.kept_only(docs).count() <= 3
    elif op == "simhash":
        assert simhash.components(docs).count() == 3
    else:
        assert pii.redacted(docs).count() == 3
