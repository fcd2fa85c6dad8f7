"""The sentence kernel against its definition, what the machine tolerates, training on odd rows and held-out quality."""

import re
import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tactus.llm import toxicity

MARKS = ["loser", "idiot", "pathetic", "moron", "trash", "stupid"]
CLEAN = "nation the condition lo trust close clone and for idiom worth path what stone river garden morning".split()


def kernel(left, right):
    """The definition: all subsequences of three characters, one by one."""

    def weights(part):
        s, out = "^" + part, defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = weights(left), weights(right)
    norm = np.sqrt((toxicity.DAMPING + sum(v * v for v in a.values())) * (toxicity.DAMPING + sum(v * v for v in b.values())))
    return (sum(v * b.get(u, 0.0) for u, v in a.items()) / norm) ** toxicity.POWER


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abidiotmrnlsex", min_size=2, max_size=24), min_size=1, max_size=6, unique=True))
def test_kernel_is_its_definition(parts):
    got = toxicity.Landmarks(MARKS).kernel(parts)
    assert got == pytest.approx(np.array([[kernel(p, m) for m in MARKS] for p in parts]), abs=1e-9)


def test_sentence_kernel_adds_the_parts():
    marks = toxicity.Landmarks(MARKS)
    text = "What a moron. You id iot, you l o s e r!\nfine"
    for words in toxicity.sentences(text):
        parts = [p for w in words for p in toxicity.parts_of(w)]
        assert marks.sentence(words) == pytest.approx(marks.kernel(parts).sum(axis=0))


def test_insults_with_inserted_signs():
    of = toxicity.Scorer(toxicity.Model.fitted(MARKS, MARKS, CLEAN * 10)).worst
    most = max(of(w)[0] for w in CLEAN)
    for insult in ["mxoxrxoxn", "lozzzser", "i d i o t", "id iot", "i.d.i.o.t", "patthetic", "mo-ron!", "you id iot"]:
        assert of(insult)[0] > most, insult
    for clean in ["the river and the stone", "what a garden", "trust the nation"]:
        assert of(clean)[0] < of("idiot")[0]


def test_two_clean_words_can_be_an_insult():
    clean = ["waste is here", "total sum", "the total of space", "space and waste", "garden waste", "river space", "total garden"] * 5
    model = toxicity.Model.fitted(["total", "waste", "space", "garden"], ["total waste of space"] * 5, clean)
    of = toxicity.Scorer(model).worst
    assert of("you total waste of space")[0] > max(of(c)[0] for c in clean)


def plain_sentences(text):
    """The definition of reading: sentence by sentence, word by word."""
    out = []
    for line in re.split(r"(?<=[.!?])\s+|\n+", text.lower()):
        words = line.split()
        step = toxicity.SENTENCE // 2
        for piece in [words[i : i + 2 * step] for i in range(0, max(1, len(words) - step), step)] if words else []:
            pairs = [a + b for a, b in zip(piece, piece[1:]) if len(a) < 4 > len(b) and len(a + b) > 3]
            runs = ["".join(g) for single, g in groupby(piece, lambda w: len(w) == 1) if single]
            out.append(list(dict.fromkeys(piece + pairs + [r for r in runs if len(r) > 2])))
    return out


WORDS = st.sampled_from(["a", "b", "é", "ab", "中文", "abc", "abcd", "you.", "İx", "!", "id", "iot"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab.!?İßK中🙂 \t\n\r\x1c\x85\xa0\u2003\u3000", max_size=60), st.lists(WORDS, max_size=130).map(" ".join)), max_size=5))
def test_texts_read_together_as_one_by_one(texts):
    cut = toxicity.read(texts)
    assert [[cut.sentence(i) for i in range(a, b)] for a, b in zip(cut.texts, cut.texts[1:])] == [plain_sentences(x) for x in texts]


def test_white_space_is_that_of_python():
    assert all(chr(c).isspace() == bool(toxicity._WIDE_SPACE.fullmatch(chr(c)) or c < 128 and toxicity._SPACE[c]) for c in range(0x110000))


def test_known_words_are_not_computed_again(monkeypatch):
    """The same letters and digits once, whatever signs stand beside them, and common words once however many follow."""
    asked = []

    class Model:
        bias = 0.0

        def margins(self, words):
            asked.extend(words)
            return np.array([len(w) for w in words], float)

    monkeypatch.setattr(toxicity, "CACHE", 100)
    monkeypatch.setattr(toxicity, "GROUP_CHARS", 1)
    scorer = toxicity.Scorer(Model())
    got = list(scorer.all(["moron, moron (moron) moron!"] + [f"common word{i}" for i in range(1000)]))
    assert got[0] == (20.0, ["moron,", "moron", "(moron)", "moron!"]) and got[-1] == (13.0, ["common", "word999"])
    assert asked.count("moron") == 1 and asked.count("common") == 1 and len(scorer.known) + len(scorer.older) < 300


def test_memory_holds_letters_and_digits_alone():
    """Words that differ in their signs take one place of the bounded memory."""
    scorer = toxicity.Scorer(toxicity.Model.fitted(MARKS, MARKS, CLEAN * 10))
    alone = scorer.worst("moron")
    scorer = toxicity.Scorer(scorer.model)
    assert [m for m, _ in scorer.all(["moron", "moron,", "(moron)", "mo-ron!", "garden?"])][:4] == [alone[0]] * 4
    assert set(scorer.known) == {"moron", "garden"}


def labelled(spark, tmp, copies=1):
    rows, labels, rng = [], [], np.random.default_rng(8)
    for i in range(600):
        toxic = i % 5 == 1
        words = [CLEAN[rng.integers(len(CLEAN))] + str(rng.integers(1000)) for _ in range(12)]  # no two texts share a sign
        rows += [(i, " ".join(words[:6]) + ". " + f"You {MARKS[i % 6] if toxic else CLEAN[i % 9]} are bad. " + " ".join(words[6:]))] * (copies if toxic else 1)
        labels.append((i, int(toxic)))
    rows += [(None, "you idiot"), (1000, None), (1001, ""), (1002, "x" * 3_000_000), (1003, "the river " * 300_000 + "you idiot"), (1004, "..!? 12"), (1000, None)]
    labels += [(None, 1), (1000, 1), (1001, 0), (1002, 0), (3, 7), (6, 1), (6, 0)]
    spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, key string, margin double").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp}/labels.parquet")
    return str(tmp), rows


@pytest.mark.parametrize("copies", [1, 30])
def test_training_on_odd_rows(spark, tmp_path, copies):
    sf, rows = labelled(spark, tmp_path / "t", copies)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = toxicity.training_rows(docs, labels).collect()
    assert len({r["sign"] for r in train}) == len(train) <= 600  # copies are one example
    got = toxicity.op5_toxicity(spark, sf).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    of = {r["doc_id"]: r for r in got}
    assert of[None]["predicted"] == 1 and of[1003]["predicted"] == 1
    assert all(of[i]["predicted"] == 0 for i in (1000, 1001, 1002, 1004))
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 1) for r in held) >= 0.95 * len(held) > 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)


def test_labels_of_the_held_out_fold_are_not_seen(spark, tmp_path):
    sf, _ = labelled(spark, tmp_path / "t")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    first, second = (sorted(map(str, toxicity.scored(docs, toxicity.train(docs, x)).collect())) for x in (labels, turned))
    assert first == second


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    found = toxicity.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in found)
    assert hits >= 0.6 * sum(r["toxic"] for r in found) and sum(r["predicted"] and not r["toxic"] for r in found) <= 0.06 * len(found)
