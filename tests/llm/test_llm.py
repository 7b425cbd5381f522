"""Every operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from riskweave.llm import bpe, chat, jaccard, mixing, quality, queries, substring, suffix, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéğ日") for _ in range(r.randint(2, 7))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [say(90) for _ in range(3)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "one TWO"), (5, "a" * 3000), (6, "x y " * 700), (7, say(3000))]
    for i in range(8, n):
        kind = i % 6
        text = say(r.randint(25, 400))
        if kind == 1:
            text = say(40) + "\n" + r.choice(shared) + " " + say(50)
        elif kind == 2 and rows[-1][1]:
            words = rows[-1][1].split(" ")
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = "edit%d" % r.randrange(10**6)
            text = " ".join(words)
        elif kind == 3 and rows[-1][1]:
            text = rows[-1][1]
        elif kind == 4:
            text = (say(12) + "\n") * 4 + say(20)
        rows.append((i, text))
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", None if t is None else len(t), "extra") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_bpe_equals_the_tokenizers_library(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    extra = ["<|endoftext|>a<|startoftext|> B'LL ½ ٣ ΑΣ", "it's\x1cx\x85y", "uuu uuuuu xxxxxxx", "é ﬁ İ", "!!!...,,,", "a\u1c89b \ua7d2", "x\U00010940y \U0003fc36", "\U000e0fff \u0378"]
    rows = [(i, t_) for i, t_ in ROWS] + [(1000 + i, x) for i, x in enumerate(extra)]
    found = by_id(bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.vocabulary(), keep_ids=True))
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert found[i]["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))
    assert bpe.encode_documents(empty, queries.vocabulary()).count() == 0


def plain_bpe(word, ranks):
    parts = list(word)
    while len(parts) > 1:
        best = min(((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] == 1 << 30:
            break
        pair = (parts[best[1]], parts[best[1] + 1])
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_automaton_on_random_merges():
    r = random.Random(5)
    for _ in range(150):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(r.randint(1, 14)):
            a, b = r.choice(list(vocab)), r.choice(list(vocab))
            if a + b not in vocab and plain_bpe(a + b, {m: i for i, m in enumerate(merges)}) == [a, b]:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        auto = bpe.MergeAutomaton(vocab, merges)
        ranks = {m: i for i, m in enumerate(merges)}
        name = {i: s for s, i in vocab.items()}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            assert [name[i] for i in auto.encode(word)] == plain_bpe(word, ranks), (merges, word)


def test_toxicity_held_out(spark, empty):
    found = queries.op2_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(found.doc_id, found.held_out, strict=True))
    test = found[found.held_out & found.doc_id.isin(labels.index)].set_index("doc_id")
    truth = labels.loc[test.index]
    assert (test.predicted == truth).mean() > 0.9
    assert test.score.between(0, 1).all() and ((test.score >= 0.3) == (test.predicted == 1)).all()
    model = toxicity.ToxicityModel(np.zeros(1 << toxicity.BITS), -1.0)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b")], "doc_id long, text string, score string")
    assert [r["predicted"] for r in toxicity.score(odd, model).collect()] == [0, 0, 0]
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_ngrams_are_of_characters():
    """Every character n-gram counts once, in any script and case, and texts don't depend on their neighbours."""
    present = toxicity.Present()
    texts = ["Idiot", "", "xy", "é idiot!", "x" * 50, "idiot " * 9, "Жопа", "日本語日本語", "a" * (toxicity.BLOCK + 9), None]
    for t in texts:
        padded = f" {(t or '').lower()} "
        grams = {padded[i : i + toxicity.ORDER] for i in range(len(padded) - toxicity.ORDER + 1)}
        one = set(present(t).tolist())
        assert len(present(t)) == len(one) <= len(grams) and len(one) >= len(grams) - 1
        assert set(toxicity.Present()(t).tolist()) == one
    assert set(present("ЖОПА!")) == set(present("жопа!")) != set(present("жопа?"))


def test_toxicity_learns_from_all_scripts_and_drops_contradictions(spark):
    """No n-gram is left out however rare or many there are; contradicting labels and repeated rows don't count twice."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(30)) + (" дурак" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 4 == 0), "clash") for i in range(200)] + [(1, 1, "x"), (2, 1, "x"), (None, 1, "x"), (3, 7, "x")]
    docs_ = spark.createDataFrame([(*x, 0.5, "t") for x in rows] * 2, "doc_id long, text string, score double, toxic string")
    model = toxicity.train(docs_, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    found = by_id(toxicity.score(docs_, model))
    assert all(found[i]["predicted"] == (i % 4 == 0) for i in range(400)) and docs_.columns == [c for c in found[0] if c != "predicted" and c != "score"][:2] + ["score", "toxic"]
    assert (model.weights != 0).sum() > 5000
    none = toxicity.train(docs_.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    assert none.score(["a", None]).max() < 1e-6


def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = ["<|end|>\n", "\\", "\\l", "\\p", "[INST]", "</s>", "<|user|>\n", "日本", " word", "\n", "\\\\<", "|>", "|"]
    rows = [(-7, 0, "user", queries.CONTROL_TEXT), (-7, 1, "assistant", queries.CONTROL_TEXT), (5, 0, None, None), (5, None, "assistant", "first"), (5, 0, None, None)]
    rows += [(6, 0, "user|>\nx", "hello"), (6, 1, "a|b\\p", "y"), (6, 2, "system", "late system " * 9), *((6, k, "assistant", "long " * 30) for k in range(3, 9))]
    for c in range(8, 20):
        for t in range(r.randint(1, 30)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))))
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, win string")
    found = by_id(chat.format_and_read(df, budget=64), "conv_id")
    for c in {x[0] for x in rows}:
        turns = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text in rows if i == c))
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        assert found[c]["n_turns"] == len(turns)
        assert found[c]["turns_sha256"] == sha("".join(f"{x[1]}\n{x[2]}\n" for x in turns))
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), sha(loss))
    windows = chat.format_windows(df, budget=64).collect()
    assert max(w["win"] for w in windows) > 2
    cost = lambda text: len(WORD.findall(text.encode())) + chat.TURN_COST
    repeated = 0
    for w in windows:
        parts = re.findall(r"<\|([^<\[|]*)\|>\n([^<\[]*)<\|end\|>\n", w["text"])
        system = w["n_context"] and parts[0][0] == "system"
        assert w["tokens"] <= 64 or len(parts) == 1 + system
        assert len(w["loss_spans"]) == sum(role == "assistant" for role, _ in parts[w["n_context"] :])
        repeated += w["n_context"] - system
        if w["conv_id"] % 2 and w["conv_id"] > 8 or w["conv_id"] == 6 and w["win"] > 1:
            assert "<|system|>" in w["text"]
    assert repeated > 5
    plain = spark.createDataFrame([(1, k, "user", "w " * n) for k, n in enumerate([10, 20, 60, 3, 3, 3, 200, 1])], "conv_id long, turn long, role string, text string")
    by = {w["win"]: w for w in chat.format_windows(plain, budget=64).collect()}
    assert sum(w["tokens"] for w in by.values()) >= sum(cost("w " * n) for n in [10, 20, 60, 3, 3, 3, 200, 1])
    assert [w["tokens"] for w in by.values() if w["tokens"] > 64] == [204]
    assert chat.format_and_read(df.limit(0)).count() == 0


def brute_quality(text):
    words = [w.decode() for w in WORD.findall((text or "").encode())]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words)}


def test_quality(spark, docs, empty):
    found = by_id(quality.quality(docs))
    for i, text in ROWS:
        want = brute_quality(text)
        assert {k: found[i][k] for k in want} == want, i
        assert not (found[i]["kept"] and want["base_failed"])
    good = " ".join(map(str, range(1000, 1040)))
    odd = spark.createDataFrame([(i, "short" if i % 3 else None, "bad") for i in range(30)] + [(30, good, "bad")] + [(100 + i, good if i % 10 else "short", None if i % 2 else "fine") for i in range(300)], "doc_id long, text string, source string")
    kept = {i: r["kept"] for i, r in by_id(quality.quality(odd)).items()}
    assert not any(kept[i] for i in range(31)) and all(kept[100 + i] == (i % 10 > 0) for i in range(300))
    assert quality.quality(empty).count() == 0


def test_host_verdicts(spark):
    """A host is judged by the fleet: of hosts at 9 %, one at 45 % fails, a tiny one with two failures of three doesn't, nor
    does any where all are at 45 %; the verdict takes good documents of the failing host along."""
    good, short = " ".join(map(str, range(1000, 1040))), "too short"
    bad_symbols = " ".join(["ab#cd$ef"] * 3 + [str(k) for k in range(1000, 1025)])
    fleet = [(h, good if k % 11 else short) for h in range(20) for k in range(220)]
    late = [("late", good if k % 20 >= 9 else short) for k in range(200)]
    few = [("few", good), ("few", short), ("few", short)]
    marked = [("marked", bad_symbols if k % 2 else good) for k in range(200)]
    frame = lambda rows: spark.createDataFrame([(i, t, str(h)) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    rows = fleet + late + few + marked
    metrics = quality.base_metrics(frame(rows))
    found = by_id(quality.host_verdicts(metrics), "host")
    assert {h for h, r in found.items() if r["host_failed"]} == {"late", "marked"}
    assert 0.1 < found["few"]["rate_base"] < 2 / 3 and found["3"]["rate_base"] == pytest.approx(1 / 11, abs=0.01)
    kept = by_id(quality.quality(frame(rows)))
    lost = [i for i, (h, t) in enumerate(rows) if not kept[i]["kept"] and not kept[i]["base_failed"]]
    assert {rows[i][0] for i in lost} == {"late", "marked"} and len(lost) > 250
    same = quality.host_verdicts(quality.base_metrics(frame([(h, good if k % 20 >= 9 else short) for h in range(9) for k in range(200)])))
    assert not any(r["host_failed"] for r in same.collect())


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8) * (1 + i % 5)]) for i in range(700)]
    rows += [(i, rows[100][1]) for i in range(700, 760)] + [(800, None), (801, [1.0, None] * 4), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (850, [1.0, 2.0]), (851, [3.0, 1.0]), (900, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, chunk=64).collect()
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in ok:
        if q % 50 == 0:
            best = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q])))[:5]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    """Scores beyond a double's and a long's exact range: none is lost, all are ordered exactly."""
    rows = [(i, [float(1 << (40 + i)), -3.0, 1e15]) for i in range(0, 30)] + [(50, [1e15, 1.0, 7.0]), (100, [-3e17, 2.0, -1e18]), (150, [2.5, 1e30, -1e30]), (151, [1e308, 0.0, 0.0]), (152, [1e300, 1e300, 5.0]), (200, [0.25, 0.5, -0.25]), (201, [0.5, 0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(df, chunk=8).collect()}
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i != 151}  # 256 * 1e308 is infinite
    for q in ok:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q))[:5]
            assert [got[q, k + 1] for k in range(5)] == [(c, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, c in best]


def test_sortable_scores(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 1 << 63, -(1 << 63) - 1, 1 << 200, -(1 << 200), *(r.randint(-(1 << b), 1 << b) for b in range(1, 150))]
    assert sorted(values, key=topk.sortable) == sorted(values)
    rows = spark.createDataFrame([(str(v), bytearray(topk.sortable(v))) for v in values], "v string, b binary").select("v", topk.as_long(F.col("b")).alias("x"))
    assert all(x == max(-(1 << 63), min((1 << 63) - 1, int(v))) for v, x in rows.collect())


def test_top_k_leaves_out_chunks_that_are_too_short(spark):
    """Chunks beyond the last that any query needs are not met, and the result is the same."""
    assert topk.last_needed(np.array([2.0, 1.0]), np.array([10.0, 6.0]), [{"c": 3, "top": 9.0}, {"c": 5, "top": 5.5}, {"c": 7, "top": 4.0}], 9) == 6
    assert topk.last_needed(np.array([2.0]), np.array([-np.inf]), [{"c": 3, "top": 9.0}, {"c": 5, "top": 0.0}], 9) == 9


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return share | stopped
        stopped |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark, docs, empty):
    found = by_id(mixing.mix(docs, block=4, shard=16))
    size = {i: len(WORD.findall((t or "").encode())) for i, t in ROWS}
    source = {i: None if i % 7 == 0 else f"s{i % 5}" for i, _ in ROWS}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    want = targets(sizes)
    for i, _ in ROWS:
        f = found[i]
        assert (f["size"], f["source_size"]) == (size[i], sizes[source[i]])
        assert f["target"] == pytest.approx(want[source[i]], rel=1e-9)
        assert 0 <= f["taken"] <= 3 * f["size"]
    for s in sizes:
        assert sum(found[i]["taken"] for i in size if source[i] == s) == pytest.approx(want[s], rel=0.05)
    assert by_id(mixing.mix(docs.repartition(5), block=4, shard=16)) == found
    texts = {}
    for r in mixing.mixed_texts(docs, block=4, shard=16).collect():
        texts[r["doc_id"]] = texts.get(r["doc_id"], 0) + len(WORD.findall(r["text"].encode()))
    assert {i: n for i, n in texts.items() if n} == {i: found[i]["taken"] for i in found if found[i]["taken"]}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0


def test_mixed_texts_of_rows_without_id_and_of_rows_that_share_one(spark):
    """Every row gets the pieces that were planned for it: words of the mixture by row equal what the plan takes."""
    r = random.Random(13)
    say = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    rows = [(i, say(r.randint(5, 90)), "a") for i in range(20)] + [(None, say(r.randint(5, 90)), s) for s in ("a", "b", None) for _ in range(8)]
    rows += [(7, say(40), "a"), (7, say(75), "b"), *[(8, "x y z " * 9, "b")] * 3, *[(None, "u v " * 7, None)] * 2, (None, None, "a"), (None, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want, got = {}, {}
    for x in mixing.mix(df, block=4, shard=16).collect():
        want[x["doc_id"], x["size"]] = want.get((x["doc_id"], x["size"]), 0) + x["taken"]
    for x in mixing.mixed_texts(df, block=4, shard=16).collect():
        words = x["text"].split()
        text = next(t for i, t, s in rows if (i, s) == (x["doc_id"], x["source"]) and t and set(words) <= set(t.split()))
        got[x["doc_id"], len(text.split())] = got.get((x["doc_id"], len(text.split())), 0) + len(words)
    assert got == {k: n for k, n in want.items() if n}
    assert sum(n for (i, _), n in got.items() if i is None) > 100


def test_small_sources_get_their_targets(spark):
    """Sources whose last block is short, stopped at three times their size beside a large one, are taken three times whole."""
    small = {f"s{n}": n for n in (65, 100, 130, 200, 400, 1000)}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(small.items())] + [(100 + i, "w " * 500, "z") for i in range(100)]
    found = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert {i: found[i]["taken"] for i in range(6)} == {i: 3 * n for i, n in enumerate(small.values())}
    assert sum(found[100 + i]["taken"] for i in range(100)) == pytest.approx(found[100]["target"], rel=0.01)


def test_index_permutations(spark):
    """For every size a permutation, another one for another source, without a visible order."""
    from pyspark.sql import functions as F

    sizes = [1, 2, 3, 6, 7, 64, 501]
    rows = spark.createDataFrame([(m, j) for m in sizes for j in range(m)], "m long, j long")
    got = rows.select("m", "j", *(mixing.permuted(F.col("j"), F.col("m"), F.lit(key)).alias(f"k{key}") for key in (1, 2))).toPandas()
    for m in sizes:
        part = got[got.m == m].sort_values("j")
        for k in ("k1", "k2"):
            assert sorted(part[k]) == list(range(m))
        if m > 60:
            assert (part.k1 != part.k2).mean() > 0.9 and abs(np.corrcoef(part.j, part.k1)[0, 1]) < 0.3
            assert len(set(np.diff(part.k1) % m)) > m // 3  # a shift or a multiple would have one or two


def test_slots_are_a_multinomial_draw_with_given_sums(spark):
    """Totals are exact, all places are filled, and counts of a source in shards vary as drawing at random makes them."""
    n = {0: 4000, 1: 9000, 2: 500, 3: 7}
    shares = spark.createDataFrame([(s, k // 2 + 1, k) for s, k in n.items()], "s long, m long, n long")
    got = mixing.slots(shares, shard=100, seed=3).toPandas()
    assert got.groupby("s").size().to_dict() == n
    per = got.groupby(["shard", "s"]).size().unstack(fill_value=0)
    assert set(per.sum(axis=1)[:-1]) == {100} and len(per) == 136
    for s in (0, 1, 2):
        p = n[s] / sum(n.values())
        assert 0.6 < per[s][:-1].var() / (100 * p * (1 - p)) < 1.5
    first = got[(got.s == 1) & (got.j < 4501)].sort_values("j")
    assert sorted(first.block) == list(range(4501))


def test_targets_stop_at_three_times_the_source(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 20, "b"), (3, "w " * 700, "c"), (4, "w " * 1000, None), (5, "w " * 5, "d")]
    found = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=4))
    want = targets({"a": 10, "b": 20, "c": 700, None: 1000, "d": 5})
    assert {i: found[i]["target"] for i in found} == pytest.approx({1: want["a"], 2: want["b"], 3: want["c"], 4: want[None], 5: want["d"]})


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            inter = len(sets[a] & sets[b])
            if a < b and inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, docs, empty, width, percent):
    found = by_id(jaccard.jaccard_links(docs, width=width, percent=percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute_components(ROWS, width, percent)
    assert jaccard.jaccard_links(empty).count() == 0


@pytest.mark.parametrize("parts", [None, 1, 3])
def test_jaccard_of_a_table_united_with_itself(spark, docs, parts):
    """Blocks that are alike in all rows stay apart: every row comes back, whatever the partitioning."""
    twice = docs.unionAll(docs) if parts is None else docs.unionAll(docs).repartition(parts)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_links(twice).collect())
    assert found == sorted((i, *x) for i, x in brute_components(ROWS, 4, 85).items() for _ in range(2))


def test_jaccard_near_group(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([*rows, (None, "a b c d e")], "doc_id long, text string").repartition(4)
    found = by_id(jaccard.jaccard_links(df))
    assert found.pop(None)["component_id"] is None
    assert {i: (x["n_shingles"], x["component_id"]) for i, x in found.items()} == brute_components(rows, 4, 85)


def test_components_of_a_long_path(spark):
    """Ids in shuffled order along a path: labels have far to go."""
    order = random.Random(3).sample(range(300), 300)
    links = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)] + [(900, 901)]
    found = jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["v"]: r["component"] for r in found} == {i: 0 for i in range(300)} | {900: 900, 901: 900}


def test_warc(spark):
    r = random.Random(4)
    html = [None, "", "short", "short", "é" * 60, "é" * 60, *("".join(r.choice("ab<>é\n") for _ in range(r.randint(0, 9000))) for _ in range(60))]
    html += [html[8], html[8], html[20]]
    rows = [(i, f"http://h/{i}\r\n", h) for i, h in enumerate(html)] + [(3, "again", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_and_read(df).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for x in got:
        payload = (html[x["page_id"]] or "").encode()
        revisit = len(payload) >= 100 and first[payload.decode()] != x["page_id"]
        assert (x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) == (len(payload), sha(payload), "revisit" if revisit else "response", first[payload.decode()] if revisit else None)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_warc_of_others(spark, tmp_path):
    """An archive as crawlers write them: warcinfo, uuid ids, several types and versions, odd headers, what is no record."""
    import gzip

    def rec(head, block, version="WARC/1.0"):
        return gzip.compress((version + "\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode("latin-1") + block + b"\r\n\r\n")

    uuid = "<urn:uuid:f9c1e5a2-0000-4000-8000-00000000000%d>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-length: 5\r\n\r\n"
    raw = [
        rec(["WARC-Type: warcinfo", "WARC-Record-ID: " + uuid % 1, "WARC-Date: 2020-01-02T03:04:05Z", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        rec(["WARC-Type: request", "WARC-Record-ID: " + uuid % 2, "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        rec(["warc-type:response", "WARC-Record-ID: " + uuid % 3, "WARC-Target-URI: http://a/\xe9\r\n b", "Content-Type: application/http;msgtype=response"], http + b"hello", "WARC/1.1"),
        rec(["WARC-Type: revisit", "WARC-Record-ID: " + uuid % 4, "WARC-Refers-To: " + uuid % 3, "WARC-Payload-Digest: sha1:ABC", "Content-Type: application/http; msgtype=response"], http),
        rec(["WARC-Type: revisit", "WARC-Record-ID: " + uuid % 5], b""),
        rec(["WARC-Type: metadata"], b"x: y"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nabc"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nabc"),
        gzip.compress(b"WARC/1.0\r\nno end"),
        gzip.compress(b"something else"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")[:-9],  # cut off
    ]
    (tmp_path / "b.warc.dat").write_bytes(b"".join(raw))
    got = {r["record_id"]: r.asDict() for r in warc.read_archives(spark, str(tmp_path), with_payload=True, with_invalid=True).collect() if r["record_id"]}
    rest = [r.asDict() for r in warc.read_archives(spark, str(tmp_path), with_payload=True, with_invalid=True).collect() if not r["record_id"]]
    assert sorted(r["record_type"] for r in rest) == ["invalid"] * 3 + ["metadata"]
    assert (got[uuid % 1]["record_type"], got[uuid % 1]["payload_bytes"], got[uuid % 1]["date"]) == ("warcinfo", 13, "2020-01-02T03:04:05Z")
    assert (got[uuid % 2]["record_type"], got[uuid % 2]["payload_bytes"], got[uuid % 2]["url"]) == ("request", 0, "http://a/")
    third = got[uuid % 3]
    assert (third["payload"], third["payload_digest"], third["page_id"]) == (b"hello", sha("hello"), None) and third["url"].endswith(" b")
    assert (got[uuid % 4]["payload_bytes"], got[uuid % 4]["payload_digest"], got[uuid % 4]["payload"]) == (5, "ABC", None)
    assert (got[uuid % 5]["payload_bytes"], got[uuid % 5]["payload_digest"]) == (None, None)
    assert warc.read_archives(spark, str(tmp_path)).count() == 6


def test_warc_has_what_the_format_requires():
    import gzip

    fields = warc.parse(gzip.decompress(warc.record(5, "http://a/", b"p" * 200, "d", 4, "2020-01-02T03:04:05Z")))
    assert {"warc-record-id", "content-length", "warc-date", "warc-type"} <= fields.keys()
    assert warc.row(fields)[:6] == (5, "http://a/", 200, "d", "revisit", 4)


def test_warc_ranges_and_false_magic(spark, tmp_path):
    """Small byte ranges cut members everywhere, and stored blocks are full of bytes that look like a magic."""
    noise = [(warc.MAGIC + bytes([8, 0, 0, 0]) + b"\x00" * 5) * k for k in range(40)]
    raw = b"".join(warc.member({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Target-URI": "u", "WARC-Payload-Digest": "x"}, b"H\r\n\r\n" + p, level=0) + b"\0" for i, p in enumerate(noise))
    (tmp_path / "a.warc").write_bytes(raw)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = warc.read_archives(spark, str(tmp_path), with_payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((x["page_id"], bytes(x["payload"])) for x in got) == list(enumerate(noise))


def brute_suffix(rows, length):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for i, b in raw.items():
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def brute_shared(rows, size):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for i, b in raw.items():
        for p in range(len(b) - size + 1):
            seen.setdefault(b[p : p + size], set()).add(i)
    out = {}
    for i, b in raw.items():
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if len(seen[b[p : p + size]]) > 1:
                mask[p : p + size] = True
        out[i] = int(mask.sum())
    return out


@pytest.mark.parametrize(("length", "passage", "crowd"), [(400, 250, 20_000), (400, 400, 20_000), (120, 90, 20_000), (70, 65, 20_000), (400, 250, 3), (120, 120, 1)])
def test_suffix(spark, docs, empty, length, passage, crowd):
    found = by_id(suffix.dedup(docs, length=length, passage=passage, crowd=crowd))
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in found.items()}
    want = brute_suffix(ROWS, length)
    assert sum(w[1] for w in want.values()) > 3000
    assert got == want
    assert {i: r["n_shared"] for i, r in found.items()} == brute_shared(ROWS, passage)
    assert suffix.dedup(empty).count() == 0


def test_suffix_of_a_table_united_with_itself(spark, docs):
    found = suffix.dedup(docs.unionAll(docs).repartition(3)).collect()
    assert len(found) == 2 * len(ROWS)
    assert all(r["n_removed"] == (r["n_bytes"] if r["n_bytes"] >= 400 else 0) for r in found)


def test_interleave_merge_on_random_strings():
    """Order and common prefixes equal those of sorted suffixes, and depend on the shards' own orders."""
    r = random.Random(6)
    wrong = 0
    for trial in range(60):
        base = [r.randint(1, 3) for _ in range(12)]
        strings = [base[r.randint(0, 6) :][: r.randint(1, 9)] + [r.randint(1, 4) for _ in range(r.randint(0, 5))] for _ in range(r.randint(2, 14))]
        cut = sorted({0, len(strings), *(r.randint(1, len(strings)) for _ in range(3))})
        parts = [[x for s in strings[a:b] for x in [*s, 0]] for a, b in zip(cut, cut[1:], strict=False)]
        symbols = np.array([x for p in parts for x in p])
        shards = [suffix.Shard(np.array(p)) for p in parts]
        depth = r.choice([1, 3, 20])
        order, common = suffix.merged(shards, depth)
        ends = np.flatnonzero(symbols == 0)
        tail = lambda p: [*symbols[p : ends[np.searchsorted(ends, p)]].tolist()]  # noqa: B023, E731
        keys = [tail(p) for p in order]
        assert sorted(order) == list(range(len(symbols)))
        assert [k[:depth] for k in keys] == sorted(k[:depth] for k in keys)
        for a, b, c in zip(keys, keys[1:], common[1:], strict=False):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert c == min(same, depth)
        for s in shards:
            mixed = np.random.default_rng(trial).permutation(len(s.order))
            s.order, s.transform = s.order[mixed], s.transform[mixed]
        order, _ = suffix.merged(shards, depth)
        wrong += [k[:depth] for k in (tail(p) for p in order)] != sorted(k[:depth] for k in keys)
    assert wrong > 50


def test_repeated_starts_on_random_windows():
    r = random.Random(7)
    for length, passage in ((70, 65), (120, 80), (400, 250)):
        for _ in range(6):
            text = bytes(r.choice(b"abcdefg") for _ in range(3000)) + b"ab" * 500
            windows, begins, owners = [], [], []
            for i in range(14):
                a = r.randrange(len(text) - length)
                own = bytes(r.choice(b"xyz") for _ in range(r.randint(0, 300)))
                windows.append(own + text[a : a + r.randint(length // 2, 2 * length)])
                begins.append(0)
                owners.append(i)
            windows += [windows[3][50:], windows[5], windows[7]]
            begins += [50, 0, 5000]
            owners += [3, 99, 7]
            for size, got in zip((length, passage), suffix.repeated_starts(windows, np.array(begins), np.array(owners), length, passage), strict=True):
                seen = {}
                at = 0
                for w, p, o in zip(windows, begins, owners, strict=True):
                    for j in range(len(w) - size + 1):
                        seen.setdefault(w[j : j + size], []).append((at + j, (o, p + j) if size == length else o))
                    at += len(w)
                want = sorted(x for v in seen.values() if len({p for _, p in v}) > 1 for x, _ in v)
                assert sorted(got) == want


def test_substring(spark, docs, empty):
    r = random.Random(8)
    say = lambda k: " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(3, 9))) for _ in range(k))
    passage = say(60)
    rows = [(i, say(200)) for i in range(40)] + [(50 + i, say(r.randint(5, 60)) + " " + passage + " " + say(80)) for i in range(12)] + [(70, None), (71, ""), (None, "x " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = by_id(substring.dedup(df, keep_text=True))
    for i, text in rows:
        if i is None or i < 50 or i == 50 or i >= 70:
            assert found[i]["n_removed"] == 0 and found[i]["text"] == text, i
        else:
            left = found[i]["text"]
            assert found[i]["n_removed"] >= len(passage.encode()) // 2 and found[i]["n_spans"] >= 1
            assert text.startswith(left[:10]) and text.endswith(left[-10:])
            assert found[i]["kept_sha256"] == sha(left) and len(left.encode()) + found[i]["n_removed"] == len(text.encode())
    assert by_id(substring.dedup(docs)).keys() == {i for i, _ in ROWS}
    assert substring.dedup(empty).count() == 0


def test_substring_finds_short_passages_wherever_they_are(spark):
    """Passages of 51 to 60 words in two contexts: all but those in which no whole chunk lies go whole, and nothing else does."""
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [say(r.randint(51, 60)) for _ in range(400)]
    rows = [(1000 * k + i, say(r.randint(10, 90)) + " # " + p + " = " + say(r.randint(10, 90))) for i, p in enumerate(passages) for k in (1, 2)]
    found = by_id(substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep_text=True))
    missed = 0
    for i, text in rows:
        if i < 2000:
            assert found[i]["n_removed"] == 0
            continue
        p, gone = passages[i % 1000], found[i]["n_removed"]
        missed += gone == 0
        if gone:
            assert len(p) <= gone <= len(p) + 12
            at = text.index(p)
            assert found[i]["text"].startswith(text[: at - 6]) and found[i]["text"].endswith(text[at + len(p) + 6 :])
    assert missed <= 6


def earlier_cover(rows, sizes):
    """Of each document, for each size the mask of bytes in strings of that size that start at an earlier place."""
    out = {}
    for size in sizes:
        seen = set()
        for i, text in sorted(rows):
            raw = (text or "").encode()
            mask = np.zeros(len(raw), bool)
            fresh = set()
            for p in range(len(raw) - size + 1):
                x = raw[p : p + size]
                if x in seen or x in fresh:
                    mask[p : p + size] = True
                fresh.add(x)
            seen |= fresh
            out[i, size] = mask
    return out


def removed_mask(raw, left, n_spans):
    """Mask of removed bytes of raw, from what is left: greedy alignment over the removed runs is ambiguous only at equal bytes."""
    import difflib

    mask = np.ones(len(raw), bool)
    for tag, a, b, _, _ in difflib.SequenceMatcher(None, raw, left, autojunk=False).get_opcodes():
        if tag == "equal":
            mask[a:b] = False
    return mask


def test_substring_against_brute_force(spark):
    """What goes lies in strings that occur earlier, and what lies in 300-byte strings that occur earlier in other documents goes."""
    r = random.Random(17)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(3, 10))) for _ in range(3000)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [say(r.randint(45, 140)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, say(30)), (3, say(30) + " " + shared[0][:290])]
    for i in range(4, 70):
        text = say(r.randint(3, 60))
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared)
            a = r.randrange(0, len(p) // 3)
            text += " " + p[a:] + "\n" + say(r.randint(1, 40))
        rows.append((i, text))
    rows.append((90, rows[40][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = by_id(substring.dedup(df, keep_text=True))
    cover = earlier_cover(rows, (40, 300))
    must = got = 0
    for i, text in rows:
        raw, left = (text or "").encode(), (found[i]["text"] or "").encode()
        gone = removed_mask(raw, left, found[i]["n_spans"])
        assert gone.sum() == found[i]["n_removed"] == len(raw) - len(left)
        assert not (gone & ~cover[i, 40]).any() or gone[~cover[i, 40]].sum() <= 4 * found[i]["n_spans"]
        must += cover[i, 300].sum()
        got += (gone & cover[i, 300]).sum()
        assert not cover[i, 300].any() or gone.any(), i
    assert must > 5000 and got >= 0.95 * must
    twice = by_id(substring.dedup(df.unionAll(df).repartition(3)))
    assert {i: r["kept_sha256"] for i, r in twice.items()} == {i: r["kept_sha256"] for i, r in found.items()}


def test_segments_have_one_owner_and_one_diagonal():
    start, size = np.array([30, 10, 20, 60, 70]), np.array([5, 10, 10, 10, 10])
    owner, place = np.array([1, 1, 1, 1, 2]), np.array([120, 100, 110, 7, 17])
    assert substring.segments(start, size, owner, place) == [(10, 35, 1, 100), (60, 70, 1, 7), (70, 80, 2, 17)]


def test_scratch_tables_go(spark):
    from riskweave.llm import scratch

    with scratch.scope(spark):
        kept = scratch.materialize(spark.range(5), "kept")
        gone = scratch.materialize(spark.range(5), "gone")
        scratch.discard(gone)
        assert kept.count() == 5
        with pytest.raises(Exception, match="(?i)path|file"):
            spark.read.parquet(gone.scratch_path_).count()
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(kept.scratch_path_).count()


def test_gear_hash_is_the_rolling_sum():
    data = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    got = substring.gear_hash(data)
    for i in range(200):
        want = sum(int(substring.GEAR[data[i - j]]) << j for j in range(min(substring.WINDOW, i + 1))) & 0xFFFFFFFF
        assert int(got[i]) == want


@pytest.fixture(scope="module")
def odd_docs(spark, docs):
    """Rows without id, repeated rows, and columns named like results or with a dot."""
    more = spark.createDataFrame([(None, "no id " * 9, "en", "s1", 54, "extra"), (None, None, "en", None, None, "extra"), (9, ROWS[9][1], "en", "s4", 5, "extra")], docs.schema)
    out = docs.unionByName(more).withColumnRenamed("__id", "a.b")
    for name in ("score", "n_removed", "id", "component_id", "row", "text_"):
        out = out.selectExpr("*", f"concat('{name}', coalesce(doc_id, -1)) as `{name}`")
    return out.repartition(3)


def extras_stay(out, docs):
    assert out.columns == docs.columns
    for r in out.collect():
        assert r["a.b"] == "extra" and all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for c in ("score", "n_removed", "id", "component_id", "row", "text_"))


def test_pipeline_toxicity_stage(spark, odd_docs, tmp_path):
    """The stage keeps exactly the rows below the threshold of the model that its labels give."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 6 == 4)) for i, _ in ROWS] + [(None, 1)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, odd_docs, str(tmp_path))
    extras_stay(kept, odd_docs)
    model = toxicity.train(odd_docs, labels.where(~queries.held_out()))
    stay = lambda t: model.score([t])[0] < 0.3
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((x for x in rows if stay(x[1])), key=str)
    assert 5 < kept.count() < len(rows)
    assert dict(corpus_pipeline.STAGES)["toxicity"](spark, odd_docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_near_duplicates_stage(spark, odd_docs):
    import corpus_pipeline

    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd_docs, SF)
    extras_stay(kept, odd_docs)
    component = {i: c for i, (_, c) in brute_components(ROWS, 5, 80).items()}
    want = [i for i in [*component, 9] if component[i] == i]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, None, *want], key=str)


def test_pipeline_substring_stage(spark, odd_docs):
    """Texts are those of the operator, which has a brute-force test; what is left blank goes; n_chars is the new length."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["substring_dedup"]
    cut = stage(spark, odd_docs, SF)
    extras_stay(cut, odd_docs)
    want = [r for r in substring.dedup(odd_docs.select("doc_id", "text", "n_chars"), keep_text=True).collect() if not r["n_removed"] or WORD.search(r["text"].encode())]
    assert any(r["n_removed"] for r in want)
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()), key=str)
    assert got == sorted(((r["doc_id"], r["text"], len(r["text"]) if r["n_removed"] else r["n_chars"]) for r in want), key=str)
    assert stage(spark, odd_docs.drop("n_chars"), SF).count() == len(want)


def test_pipeline_mixing_stage(spark, odd_docs):
    """Words by row are those that the plan takes, and sources come near their targets."""
    import corpus_pipeline

    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, odd_docs, SF)
    extras_stay(mixed, odd_docs)
    taken = {}
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"].encode()))
    want = {}
    for r in mixing.mix(odd_docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in want.items() if n}


def test_pipeline_from_end_to_end(spark, tmp_path, monkeypatch):
    """run() is its stages in a row, on a small copy of the tables; the last stage's ids are those of the mixture's texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    for name in ("documents", "labels"):
        part = spark.read.parquet(f"{SF}/{name}.parquet")
        part.limit(0 if name == "none" else 10**6).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, mixture = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage_{name}"))
        docs = mixture = spark.read.parquet(str(tmp_path / f"stage_{name}"))
        sizes.append(docs.count())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    want = sorted((r["doc_id"], sha(" ".join(map(str, t.encode(r["text"], add_special_tokens=False).ids)))) for r in mixture.collect())
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and sizes[0] > sizes[1] > sizes[2] >= sizes[3]


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_pipeline_stages_of_an_empty_table(spark, empty, stage):
    import corpus_pipeline

    assert corpus_pipeline.STAGES[stage][1](spark, empty, SF).count() == 0


CLASHING = ["id", "key", "row", "n", "part", "unit", "anchor", "win", "spans", "ends", "size", "s", "block", "token", "component", "host", "w", "v", "dim", "norm", "whole", "digest", "member", "score", "n_bytes", "n_removed", "taken", "a.b"]


@pytest.mark.parametrize("name", ["bpe", "quality", "mixing", "jaccard", "suffix", "substring", "topk", "warc"])
def test_extra_columns_with_clashing_names_change_nothing(spark, docs, name):
    from pyspark.sql import functions as F

    tables = {
        "topk": spark.createDataFrame([(i, [float(i % 7), 1.5, float(-i)]) for i in range(60)], "vec_id long, embedding array<float>"),
        "warc": spark.createDataFrame([(i, "u", "p" * (i % 3) * 80) for i in range(12)], "page_id long, url string, html string"),
    }
    run = {
        "bpe": lambda d: bpe.encode_documents(d, queries.vocabulary()), "quality": quality.quality, "mixing": lambda d: mixing.mix(d, block=4, shard=16), "jaccard": jaccard.jaccard_links, "suffix": suffix.dedup,
        "substring": substring.dedup, "topk": topk.top_k, "warc": warc.archive_and_read,
    }[name]
    plain = tables.get(name, docs.select("doc_id", "text", "source").where("doc_id < 30"))
    wide = plain.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHING])
    show = lambda df: sorted((tuple(r) for r in df.drop("date").collect()), key=str)
    assert show(run(wide)) == show(run(plain))
