import json
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gantry.llm import queries
from gantry.llm.conversations import read_messages, rebuild_conversations, reply_links, with_parents
from gantry.llm.mixing import entropy, mix_sources, solve_weights
from gantry.llm.packing import pack_documents, pack_histogram, packing_report
from gantry.llm.ranking import INDIFFERENT, STRICT, outranking
from gantry.llm.spam import LINK, NUMBER, TAG, judge_pages, word_pairs

MESSAGE = "id string, conversation_id string, role string, content_json string, created_at timestamp_ntz"


def _conversation(cid, turns, start=datetime(2024, 1, 1), step=60):
    return [(f"{cid}{i}", cid, role, text, start + timedelta(seconds=i * step)) for i, (role, text) in enumerate(turns)]


def test_rebuild_conversations(spark):
    call = lambda result: json.dumps({"text": "", "tool_calls": [{"id": "c", "name": "n", "arguments": {}, "result": result}]})
    rows = [
        *_conversation("ok", [("System", "be kind"), ("user", json.dumps({"text": "hi"})), (" AI", call({"a": 1}))]),
        *_conversation("two", [("human", "a"), ("Assistant ", "b"), ("USER", "c"), ("assistant", call("x"))]),
        *_conversation("open", [("user", "a"), ("assistant", call(None))]),
        *_conversation("blank", [("user", "  \n"), ("assistant", "b")]),
        *_conversation("noreply", [("user", "a"), ("assistant", "b"), ("user", "c")]),
        *_conversation("late", [("user", "a"), ("system", "s"), ("assistant", "b")]),
        *_conversation("twice", [("user", "a"), ("user", "b"), ("assistant", "b")]),
        *_conversation("role", [("user", "a"), (None, "b")]),
        *_conversation("first", [("assistant", "a"), ("user", "b"), ("assistant", "c")]),
        *_conversation("ghost", [("user", "a"), ("assistant", "b")]),
        *_conversation("tie", [("assistant", "b"), ("user", "a"), ("system", "s")], step=0),
        ("x", "nulltime", "user", "a", None), ("y", "nulltime", "assistant", "b", datetime(2024, 1, 1)),
        ("z", None, "user", "a", None), *_conversation("nul", [("user", None), ("assistant", "b")]),
    ]
    long = _conversation("long", [(("user", "assistant")[i % 2], f"t{i} " + "w" * 50) for i in range(9000)], step=1)
    df = spark.createDataFrame(rows + rows[:5] + long, MESSAGE).withColumn("text", F.lit(1))
    listed = spark.createDataFrame([(c,) for c in {r[1] for r in rows} - {"ghost"}] + [("long",), ("ok",)], "id string")
    got = [(r["conversation_id"], r["turn_no"], r["message_id"]) for r in rebuild_conversations(df, listed).collect()]
    kept = {"ok": ["ok0", "ok1", "ok2"], "two": ["two0", "two1", "two2", "two3"], "tie": ["tie2", "tie1", "tie0"], "long": [f"long{i}" for i in range(9000)]}
    assert sorted(got) == sorted((c, i + 1, m) for c, ms in kept.items() for i, m in enumerate(ms))
    assert rebuild_conversations(df.limit(0), listed).count() == 0


def test_outranking_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"n{i}", rng.choice([None, float("nan"), 0.0, rng.random() * 10 ** rng.randint(-6, 6)]), rng.choice([None, rng.randint(0, 4)])) for i in range(60)]
    got = {r["k"]: r for r in outranking(spark.createDataFrame(rows, "u string, k string, s double, t int"), ["k"], "u", {"s": 2.0, "t": 1.0}).collect()}

    def percentile(values):
        return [None if v is None else (2 * sum(x < v for x in values if x is not None) + sum(x == v for x in values if x is not None)) / (2 * sum(x is not None for x in values)) for v in values]

    def flow(points, i):
        if points[i] is None:
            return 0.0
        others = [p for j, p in enumerate(points) if j != i and p is not None]
        prefer = lambda d: min(1.0, max(0.0, (d - INDIFFERENT) / (STRICT - INDIFFERENT)))
        return sum(prefer(points[i] - p) - prefer(p - points[i]) for p in others) / len(others) if others else 0.0

    everything = {}
    for unit in "ab":
        own = [r for r in rows if r[0] == unit]
        points = [percentile([None if r[c] is None or r[c] != r[c] else float(r[c]) for r in own]) for c in (2, 3)]
        flows = []
        for i, r in enumerate(own):
            f = (2 * flow(points[0], i) + flow(points[1], i)) / 3
            assert got[r[1]]["flow"] == pytest.approx(f, abs=1e-8)
            flows.append((-round(f, 9), r[1]))
            everything[r[1]] = (points[0][i], points[1][i])
        assert [k for _, k in sorted(flows)] == [k for k, _ in sorted(((k, got[k]["unit_rank"]) for _, k in flows), key=lambda x: x[1])]
    names = list(everything)
    for i, k in enumerate(names):
        f = (2 * flow([everything[n][0] for n in names], i) + flow([everything[n][1] for n in names], i)) / 3
        assert got[k]["overall_flow"] == pytest.approx(f, abs=1e-8)
    assert sorted(r["overall_rank"] for r in got.values()) == list(range(1, 61))
    assert outranking(spark.createDataFrame([], "u string, k string, s double, t int"), ["k"], "u", {"s": 2.0, "t": 1.0}).count() == 0


def test_pack_histogram_keeps_every_item():
    rng = np.random.default_rng(3)
    for capacity in (7, 64, 512):
        histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, capacity + 1, 3000), return_counts=True))}
        packs = pack_histogram(histogram, capacity)
        back: dict[int, int] = {}
        for count, lengths in packs:
            assert sum(lengths) <= capacity and count > 0
            for x in lengths:
                back[x] = back.get(x, 0) + count
        assert back == histogram
        used = sum(c for c, _ in packs)
        assert used <= 1.12 * sum(k * v for k, v in histogram.items()) / capacity + 1


def test_pack_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(300)] + [(900, None), (901, ""), (902, "many words " * 3000)], "doc_id bigint, text string").withColumn("n_tokens", F.lit("x"))
    out = pack_documents(docs, [("w", 64), ("v", 1000)])
    rows = out.collect()
    for name, capacity in (("w", 64), ("v", 1000)):
        filled: dict = {}
        parts: dict = {}
        for r in rows:
            if r["window_name"] == name:
                filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["n_tokens"]
                parts.setdefault(r["doc_id"], []).append((r["part_no"], r["first_token"], r["n_tokens"]))
        assert max(filled.values()) <= capacity and sorted(filled) == list(range(len(filled)))
        assert set(parts) == {i for i in range(300) if i % 40} | {902}
        for p in parts.values():
            p.sort()
            assert [x[0] for x in p] == list(range(len(p))) and all(x[2] == capacity for x in p[:-1]) and all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:]))
    report = packing_report(out, spark.createDataFrame([("w", 64), ("v", 1000), ("none", 5)], "window_name string, capacity_tokens int"))
    assert {r["window_name"]: r["unused_share"] is None for r in report.collect()} == {"w": False, "v": False, "none": True}
    assert pack_documents(docs.limit(0), [("w", 64)]).count() == 0


def test_solve_weights():
    tokens, targets, repeats = {"a": 1000, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}
    weights, budget, exponent, flat = solve_weights(tokens, targets, repeats)
    assert weights == pytest.approx(targets) and budget == pytest.approx(200) and 0 <= exponent <= 1
    natural = {"a": 1000 / 1110, "b": 100 / 1110, "c": 10 / 1110}
    powers = {s: x**flat for s, x in natural.items()}
    assert entropy({s: x / sum(powers.values()) for s, x in powers.items()}) == pytest.approx(entropy(targets), abs=1e-6)
    for want in (150.0, 600.0, 1110.0, 5000.0):
        weights, budget, exponent, _ = solve_weights(tokens, targets, repeats, want)
        assert sum(weights.values()) == pytest.approx(1) and all(budget * weights[s] <= repeats[s] * tokens[s] * (1 + 1e-9) for s in tokens) and 0 <= exponent <= 1
    # the bisected exponents end where pouring the budget by targets up to the limits ends
    rng = random.Random(4)
    for _ in range(60):
        names = "abcdef"[: rng.randint(1, 6)]
        tokens, repeats = {s: rng.randint(1, 10 ** rng.randint(1, 6)) for s in names}, {s: rng.randint(1, 5) for s in names}
        targets = {s: rng.random() + 0.01 for s in names}
        want = rng.random() * 2 * sum(tokens.values()) + 1
        weights, budget, exponent, _ = solve_weights(tokens, targets, repeats, want)
        low, high = 0.0, 1e12
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(repeats[s] * tokens[s], mid * targets[s]) for s in names) <= budget else (low, mid)
        for s in names:
            assert budget * weights[s] == pytest.approx(min(repeats[s] * tokens[s], low * targets[s]), rel=1e-6)
    assert solve_weights({}, targets, repeats) == ({}, 0.0, 0.0, 0.0)


def test_mix_sources(spark):
    docs = [(i, "a", "some words here " * 5) for i in range(400)] + [(1000 + i, "b", "other words " * 4) for i in range(60)] + [(2000 + i, "c", "third") for i in range(90)] + [(3000, None, "x"), (3001, "d", "x"), (3002, "a", None), (3003, "b", "")]
    documents = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    for full in (False, True):
        mix, report = mix_sources(documents, targets, full)
        uses = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy_no").alias("d")).collect()
        assert all(r["n"] == r["d"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in uses)
        shares = {r["source"]: r for r in report.collect()}
        for s in "abc":
            assert shares[s]["reached_share"] == pytest.approx(shares[s]["weight"], abs=0.02)
            if not full:
                assert shares[s]["weight"] == pytest.approx(shares[s]["target_share"])
    assert mix_sources(documents.limit(0), targets)[0].count() == 0


def _corpus(rng, n=200):
    nouns, verbs = [f"noun{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)], ["keeps", "reads", "drops", "moves"]
    say = lambda: f"When the {rng.choice(nouns)} has no {rng.choice(nouns)}, the team {rng.choice(verbs)} it and says so in the log."
    # as in any corpus, code and links aren't the matter of one page alone
    code = lambda i: "\n```\nx = f(a, b)\nreturn x\n```\n" if i % 7 == 0 else f" See https://a.example/{i}: " if i % 7 == 1 else " "
    return nouns, say, [(i, code(i).join([say() + " " + say() for _ in range(3)])) for i in range(n)]


def test_spam_pages(spark):
    rng = random.Random(2)
    nouns, say, good = _corpus(rng)
    spam = [(900, ", ".join(["buy cheap nounaa now"] * 30)), (901, "\n".join(f"* {rng.choice(nouns)} {rng.choice(nouns)}: https://a{i}.example/x?p={i}" for i in range(30))), (902, " ".join(f"#tag{i}" for i in range(40))), (904, " / ".join(rng.choice(nouns) + " " + rng.choice(nouns) for _ in range(60)))]
    other = [(800, None), (801, ""), (802, "fix: load"), (803, say() + "\n```\n" + "x = f(a, b)\nreturn x\n```\n" + say()), (804, "- [a](https://a.example/x): " + say() + "\n- [b](https://b.example/y): " + say()), (805, "one"), (806, "x " * 5)]
    pages = spark.createDataFrame(good + spam + other, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("pairs", F.lit("clash"))
    got = {r["doc_id"]: r["spam"] for r in judge_pages(pages.select("doc_id", "text")).collect()}
    assert {k for k, v in got.items() if v} == {k for k, _ in spam} and len(got) == len(good + spam + other)
    assert judge_pages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_word_pairs_equal_brute_force(spark):
    text = "The Größe of <b>x</b> https://a.example/p?q=1 is 42, see docs.site.test/x #tag_1 the größe of x"
    rows = word_pairs(spark.createDataFrame([("t", text), ("e", ""), ("o", "one")], "h string, text string"))
    hashed = {r["k"]: r["w"] for r in spark.createDataFrame([(w,) for w in ["the", "größe", "of", "x", "is", "see", LINK, TAG, NUMBER]], "w string").select(F.xxhash64("w").alias("k"), "w").collect()}
    got = {(hashed[r["x"]], hashed[r["y"]]): r["n"] for r in rows.collect()}
    words = ["the", "größe", "of", "x", LINK, "is", NUMBER, "see", LINK, TAG, "the", "größe", "of", "x"]
    assert got == dict(Counter(zip(words, words[1:])))


def test_copies_of_a_spam_page_do_not_vouch_for_it(spark):
    rng = random.Random(2)
    nouns, say, good = _corpus(rng)
    page = " / ".join(rng.choice(nouns) + " " + rng.choice(nouns) for _ in range(60))
    copies = [(900 + i, page) for i in range(100)]
    schema = "doc_id bigint, text string"
    alone = judge_pages(spark.createDataFrame([*good, copies[0]], schema)).filter("doc_id = 900").first()
    got = judge_pages(spark.createDataFrame([*good, *copies, (300, good[0][1]), (301, None), (302, None)], schema)).filter("doc_id >= 300").collect()
    assert sorted(r["doc_id"] for r in got) == [300, 301, 302] + [k for k, _ in copies]
    for r in got:
        if r["doc_id"] >= 900:
            assert r["spam"] and r["normalised"] == pytest.approx(alone["normalised"])
        else:
            assert not r["spam"]


def test_reply_links_in_interleaved_channels(spark):
    """Recall of the true parent where many topical conversations run at once in one channel, and of mentions at any distance."""
    rng = random.Random(7)
    for density in (2, 10, 50):
        rows, parent = [], {}
        for c in range(density):
            topic = [f"topic{c}word{i}" for i in range(12)]
            at = datetime(2024, 1, 1) + timedelta(seconds=rng.random() * 600)
            for t in range(12):
                at += timedelta(seconds=20 + rng.random() * 100)
                key = f"d{density}c{c}t{t}"
                rows.append((key, str(density), ("user", "assistant")[t % 2], "please check the " + " ".join(rng.sample(topic, 6)), at))
                if t:
                    parent[key] = f"d{density}c{c}t{t - 1}"
        # the owner of an id that is mentioned an hour and a half later
        rows.append((f"d{density}late", str(density), "user", f"about d{density}c0t1 again", datetime(2024, 1, 1, 1, 30)))
        parent[f"d{density}late"] = f"d{density}c0t1"
        found = reply_links(read_messages(spark.createDataFrame(rows, MESSAGE)), "conversation_id")
        links = {r["message_id"]: r["parent_id"] for r in with_parents(found, "conversation_id").collect()}
        right = sum(links[k] == v for k, v in parent.items())
        assert right / len(parent) >= 0.9, (density, right / len(parent))
        assert links[f"d{density}late"] == f"d{density}c0t1"


def test_mix_query_is_as_large_as_the_documents_let_it_be(spark, tmp_path):
    docs = [(i, "a", "some words here " * 5) for i in range(400)] + [(1000 + i, "b", "other words " * 4) for i in range(60)] + [(2000, "c", "third")]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    uses = {r["source"]: r["count"] for r in queries.p9_mix(spark, str(tmp_path)).groupBy("source").count().collect()}
    assert uses["b"] == 120 and uses["c"] == 1 and uses["a"] > 300
    assert queries.p9_exact(spark, str(tmp_path)).count() < 5
