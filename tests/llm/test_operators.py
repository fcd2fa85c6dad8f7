"""The ten operators against brute force, on odd rows and on the smallest scale."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tactus.llm import bpe, chat, mixing, pii, quality, registry, sharding, simhash, tokenstore, topk, toxicity
from tactus.llm.components import stars

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module", params=["odd", "sf"])
def sf(request, odd, sf_dir):
    return odd if request.param == "odd" else sf_dir


@pytest.mark.parametrize("name", [n for n in registry.queries()])
def test_empty_tables(spark, empty, name):
    found = registry.queries()[name](spark, empty).collect()
    assert len(found) == (1 if name == "op10_chat_format" else 0)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.queries()[name](spark, sf_dir)
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert bag(df.select(*names).collect()) == bag(rel.fetchall())


def quality_of(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality(spark, sf):
    got = quality.op1_quality_rules(spark, sf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert bag(got) == bag((d, *quality_of(t)) for d, t in rows_of(spark, sf))


def test_quality_keeps_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = quality.kept_only(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {d for d, _ in rows_of(spark, odd)}


def test_tokens(spark, sf):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for d, text in sorted(rows_of(spark, sf), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert bag(tokenstore.op2_token_store(spark, sf).collect()) == bag(want)


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_pack(values):
    v = np.array(values, "<u4")
    assert (tokenstore.unpack(*tokenstore.pack(v), len(v)) == v).all()


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.ranks_of(MULTI)
    return bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t aehtnéßöñ.,!'0123456789$%<|>　日本語🙂\x1cſsT", max_size=40))
def test_bpe_is_tiktoken(codec, text):
    own, other = codec
    ids = next(iter(own.encode_all([text])))
    assert ids.tolist() == other.encode_ordinary(text) and own.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, " " * 5000, "\n " * 3000 + "x", "é" * 7000, "=" * 9001])
def test_bpe_long_runs(codec, text):
    own, other = codec
    assert next(iter(own.encode_all([text]))).tolist() == other.encode_ordinary(text)


def test_bpe_tokens_encode_themselves(codec):
    own, _ = codec
    assert all(own.segment(token) == (i,) for token, i in list(own.ranks.items())[::7])


def test_bpe_query(spark, sf, codec):
    want = []
    for d, text in rows_of(spark, sf):
        ids = codec[1].encode_ordinary(text or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert bag(bpe.op3_byte_bpe(spark, sf).collect()) == bag(want)


def print_of(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def roots(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return root


def test_simhash(spark, sf):
    docs = [(d, print_of(t)) for d, t in rows_of(spark, sf)]
    root, low = roots({p for _, p in docs}), {}
    for d, p in docs:
        if d is not None:
            low[root(p)] = min(d, low.get(root(p), d))
    assert bag(simhash.op4_simhash(spark, sf).collect()) == bag((d, f"{p:016x}", low.get(root(p))) for d, p in docs)


def test_simhash_dense_groups(spark):
    rng, prints = np.random.default_rng(5), set()
    for _ in range(20):
        base = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 120))):
            x = base
            for _ in range(int(rng.integers(0, 9))):
                x ^= 1 << int(rng.integers(0, 20))
            prints.add(x)
    star = {r["b"]: r["a"] for r in stars(simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))).collect()}
    root = roots(prints)
    assert len({star.get(x, x) for x in prints}) == len({root(x) for x in prints})
    assert all(root(a) == root(b) for b, a in star.items())


def test_simhash_search_by_table():
    fp = np.unique(np.random.default_rng(0).integers(0, 1 << 24, 5000).astype(np.uint64) & np.uint64(0x0F0FFF))
    number = simhash.LISTS.index((3, 4, 5, 6, 7))
    assert len(list(simhash._forest(fp))) == len(list(simhash._forest_by_table(fp, number)))


def test_one_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.one_of_each(docs)
    root = roots({print_of(t) for _, t in rows_of(spark, sf)})
    assert kept.columns == docs.columns
    assert Counter(root(print_of(r["text"])) for r in kept.collect()) == Counter({root(print_of(t)) for _, t in rows_of(spark, sf)})


def test_toxicity(spark, sf):
    got = toxicity.op5_toxicity(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows_of(spark, sf))
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)


def test_toxicity_learns():
    clean = "nation the condition lo trust close clone and for idiom worth path what stone river garden morning".split() * 10
    toxic = ["loser", "idiot", "pathetic", "moron", "trash", "stupid"]
    model = toxicity.Model.fitted(toxic, toxic, clean)
    of = toxicity.Scorer(model).worst
    assert min(of(w)[0] for w in [*toxic, "you i.d.i.o.t", "an id-iot!", "i d i o t"]) > max(of(w)[0] for w in clean)
    assert of("")[0] < model.bias


def test_topk(spark, odd):
    rows = {}
    for r in topk.scaled(spark.read.parquet(f"{odd}/embeddings.parquet")).collect():
        rows.setdefault(r["vec_id"], set()).add(tuple(r["v"]))
    want = []
    for q in rows:
        if q % 50 == 0:
            scores = {x: max(sum(a * b for a, b in zip(u, v)) for u in rows[q] for v in rows[x] if len(u) == len(v)) for x in rows if x != q and any(len(u) == len(v) for u in rows[q] for v in rows[x])}
            want += [(q, i + 1, x, int(scores[x])) for i, x in enumerate(sorted(scores, key=lambda x: (-scores[x], x))[:5])]
    assert bag(topk.op6_topk(spark, odd).collect()) == bag(want)


@pytest.mark.parametrize("scale", [1.0, 2.0**40])
def test_cover_trees_are_exact(scale):
    rng = np.random.default_rng(2)
    points, queries = np.floor(rng.normal(size=(700, 8)) * 50) * scale, np.floor(rng.normal(size=(90, 8)) * 50) * scale
    ids = rng.permutation(700)
    search = topk.Search(queries, 4)
    search.run(points, ids, topk.cover_tree(points))
    for q, got in zip(queries, search.ids):
        exact = [sum(int(a) * int(b) for a, b in zip(q, p)) for p in points]
        assert list(got) == [ids[i] for i in sorted(range(700), key=lambda i: (-exact[i], ids[i]))[:4]]


def test_sharding(spark, sf):
    got = sharding.op7_sharding(spark, sf).collect()
    sizes = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows_of(spark, sf))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    slots = {}
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        cost = [-np.log(((xxhash.xxh64_intdigest(f"{key}:{s}".encode(), 42) >> 11) + 0.5) / 2**53) for s in range(41)]
        assert r["shard"] == int(np.argmin(cost[:40])) and r["grown_shard"] == int(np.argmin(cost)) and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixing_stays_within_a_block(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = mixing.scheduled(docs, block_rows=1).selectExpr("row.source", "share", "period", "slot", "release", "deadline").collect()
    assert len({b["slot"] for b in blocks}) == len(blocks) and all(b["release"] <= b["slot"] < b["deadline"] for b in blocks)
    last = {}
    for b in blocks:
        last[b["source"]] = max(last.get(b["source"], 0), b["slot"])
    for t in range(min(last.values()) + 1):
        for source, share, period in {(b["source"], b["share"], b["period"]) for b in blocks}:
            assert abs(sum(b["source"] == source and b["slot"] < t for b in blocks) - t * share / period) < 1


def test_mixing_keeps_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mixed(docs, weights={"a": 2.0, "b": 1.0, "c": 1.0, None: 0.5})
    assert out.columns == docs.columns and bag(out.collect()) == bag(docs.collect())


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


@settings(max_examples=500, deadline=None)
@given(st.one_of(*[st.text(alphabet=a, max_size=50) for a in ("ab1.@-+ ", "0123456789 -.+()", "0 -", "12.@a é🙂+")]))
def test_pii_base(text):
    assert pii.listed(pii.finder().spans(text)[0]) == base_of(text)


def test_pii_query(spark, sf):
    got = [(r["doc_id"], r["base_sha256"]) for r in pii.op9_pii(spark, sf).collect()]
    assert bag(got) == bag((d, hashlib.sha256(base_of(t or "").encode()).hexdigest()) for d, t in rows_of(spark, sf))


def test_pii_added():
    assert pii.masked("iban DE89 3704 0044 0532 0130 00 ok") == "iban <ACCOUNT> ok"
    assert pii.masked("john [at] example [dot] com, or we met at noon.") == "<EMAIL>, or we met at noon."
    assert pii.masked('token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"') == 'token = "<ACCOUNT>"'


def test_pii_redacts_whole_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "@" not in out.where("doc_id = 4").first()["text"]


def test_chat(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    want = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = chat.op10_chat_format(spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()
    assert bag(got) == bag(want)


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 0, 5, "edit", "user", "hello"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", "assistant", "a"),
        (1, 1, 3, "delta", "assistant", "b"), (1, 1, 6, "regenerate", "assistant", ""), (1, 1, 7, "delta", "assistant", "c"), (1, 1, 8, "delta", "assistant", "d"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, event string, role string, text string")
    out = chat.read_back(chat.render(chat.fold(df))).orderBy("place").collect()
    assert [(r["role"], r["text"], r["loss"]) for r in out] == [("user", "hello", False), ("assistant", "cd", True)]


def test_pipeline(spark, sf, codec):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in quality.kept_only(docs).collect()]
    root, best = roots({print_of(t) for _, t in kept}), {}
    for d, t in kept:
        key = root(print_of(t))
        rank = (d is None, d or 0)
        if key not in best or rank < best[key][0]:
            best[key] = rank, d, t
    want = []
    for _, d, t in best.values():
        text = pii.masked(t)
        ids = codec[1].encode_ordinary(text)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert bag(corpus_pipeline.run(spark, sf).collect()) == bag(want)
