import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import checks, dedup, examples, filters, metrics, overlap, select
from quarry.operators.components import connected_components


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_normal_forms(spark):
    texts = ["Let $x_1$ be \\left( 2 \\right), ok?", "Étre x² áb", "", "x2 \\dfrac{1}{2} \\text{cm}"]
    rows = frame(spark, [(t,) for t in texts], "t string").select(T.normal_v2(F.col("t")).alias("a"), T.normal_lexical(F.col("t")).alias("b")).collect()
    assert rows[0].a == "let x_1 be 2 ok" and rows[0].b == "let x 1 be 2 ok"
    assert rows[1].a == "étre x² a b" and rows[1].b == "étre x² a b"
    assert rows[2].a == "" and rows[3].b == "x 2 frac 1 2 cm"


def test_coverage_is_per_item_and_distinct(spark):
    rows = frame(spark, [(1, "a b a b a b c d"), (2, "c d e"), (3, None), (4, "x abc y")], "id long, text string")
    items = frame(spark, [("s", 1, "a b c d e"), ("s", 2, "abc"), ("t", 3, "q r s t")], "eval_set string, item_id long, text string")
    got = {(r.id, r.item_id): (r.coverage, r.method) for r in overlap.matches(rows, items, 2).collect()}
    assert got == {(1, 1): (0.75, "ngram_coverage"), (2, 1): (0.5, "ngram_coverage"), (4, 2): (1.0, "short_exact_substring")}
    told = {r.id: r.status for r in overlap.status(rows, overlap.matches(rows, items, 2)).collect()}
    assert told == {1: "removed", 2: "near_miss", 3: "kept", 4: "removed"}
    assert {r.eval_set: r.removed for r in overlap.removal_counts(overlap.matches(rows, items, 2), items).collect()} == {"s": 2, "t": 0}
    with pytest.raises(Exception, match="empty normal form"):
        overlap.matches(rows, frame(spark, [("s", 1, "?!")], "eval_set string, item_id long, text string")).collect()
    with pytest.raises(ValueError):
        overlap.validate(0, 0.7, 0.5)


def test_number_variants(spark):
    rows = frame(spark, [(1, "Add 3 and 44"), (2, "Add 3 and 4"), (3, "Add x")], "id long, text string")
    items = frame(spark, [("s", 9, "add 3 and 4!")], "eval_set string, item_id long, text string")
    assert [tuple(r) for r in overlap.number_variants(rows, items).collect()] == [(1, "s", 9)]


def test_near_clusters_against_all_pairs(spark):
    """All subsets of two to four of five words, unigrams, similarity one half."""
    from itertools import combinations

    sets = [c for n in (2, 3, 4) for c in combinations("abcde", n)]
    rows = frame(spark, [(i, " ".join(s)) for i, s in enumerate(sets)], "id long, text string")
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.5}
    assert {(r.u, r.v) for r in dedup.near_links(rows, 1, 0.5).collect()} == want
    assert {r.root for r in dedup.near_clusters(rows, 1, 0.5).collect()} == {0}


def test_components(spark):
    links = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 1)], "u long, v long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_conflicts_compare_to_the_representative(spark):
    rows = frame(spark, [(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", 2), (5, "c", None), (6, "d", None), (7, "d", 1)], "id long, cluster string, answer long")
    got = {r.cluster: (r.representative, r.conflict) for r in dedup.conflicts(rows, "cluster", [F.col("id")], lambda a, b: a == b).collect()}
    assert got == {"a": (1, False), "b": (3, True), "c": (5, False), "d": (6, True)}


def test_greedy_solutions(spark):
    rows = frame(spark, [(1, 1, "a b c d e f"), (1, 2, "a b c d e f g"), (1, 3, "q r s t u"), (2, 4, None), (2, 5, "x")], "p long, id long, text string")
    assert sorted((r.problem, r.id, r.place) for r in dedup.greedy_solutions(rows, "p").collect()) == [(1, 1, 2), (1, 3, 1), (2, 5, 1)]
    assert dedup.greedy_solutions(rows.limit(0), "p").count() == 0
    with pytest.raises(ValueError):
        dedup.greedy_solutions(rows, "p", 4, 0)


def test_greedy_solutions_against_all_comparisons(spark):
    import random

    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(120)]
    rows = frame(spark, [(i % 2, i, t) for i, t in enumerate(texts + texts[:40])], "p long, id long, text string")
    want = []
    for p in (0, 1):
        chosen = []
        for i, t in sorted(((i, t) for i, t in enumerate(texts + texts[:40]) if i % 2 == p), key=lambda x: (len(x[1]), x[0])):
            w = t.split()
            own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or {tuple(w)}
            if all(len(own & x) / len(own | x) < 0.7 for x in chosen):
                chosen.append(own)
                want.append((p, i, len(chosen)))
    assert sorted(tuple(x) for x in dedup.greedy_solutions(rows, "p").collect()) == sorted(want)


def test_pass_at_k(spark):
    rows = [(n, c, k) for n in range(1, 7) for c in range(n + 1) for k in range(1, n + 1)]
    for k in range(1, 7):
        own = frame(spark, [r for r in rows if r[2] == k], "n long, c long, k long")
        for r in own.select("n", "c", metrics.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect():
            assert r.p == pytest.approx(1 - math.comb(r.n - r.c, k) / math.comb(r.n, k))


def test_empty_means_are_null(spark):
    rows = frame(spark, [("m", 1, False, 5.0), ("m", 1, False, 7.0)], "m string, id long, correct boolean, tokens double")
    (r,) = metrics.sample_metrics(rows, ["m"], (1, 4)).collect()
    assert (r.avg, r.tokens_all, r.tokens_correct, r.tokens_incorrect, r.pass_1, r.pass_4) == (0, 6, None, 6, 0, None)


def test_traces(spark):
    schema = "id long, source string, problem string, generations array<string>, correct array<boolean>, finish array<string>, complete array<boolean>"
    tokens = lambda c: F.size(F.split(F.trim(c), " "))
    rows = [(1, "s", "p", ["a b", "a b c", " ", "x", "y", "z"], [True, True, True, None, True, True], ["stop", None, "stop", "stop", "length", None], [None, True, None, None, None, False]), (2, "s", " ", ["a"], [True], None, None)]
    told = filters.traces(frame(spark, rows, schema), 3, tokens)
    assert {(r.id, r.place): r.reason for r in told.collect()} == {(1, 0): None, (1, 1): "overlength", (1, 2): "empty_generation", (1, 3): "incorrect_or_unverified", (1, 4): "truncated", (1, 5): "incomplete_reasoning", (2, 0): "invalid_problem"}
    (kept,) = filters.kept_traces(told).collect()
    assert (kept.generations, kept.places, kept.lengths) == (["a b"], [0], [3])
    with pytest.raises(Exception, match="misaligned"):
        filters.traces(frame(spark, [(1, "s", "p", ["a"], [True, False], None, None)], schema), 3, tokens).collect()


def test_stale_review_is_an_error(spark):
    import hashlib

    rows = frame(spark, [(1, "text", "3", "s")], "id long, text string, gold string, source string")
    good = hashlib.sha256(b"text").hexdigest()
    make = lambda d: frame(spark, [(1, d, "3", "correct", "4")], "id long, digest string, expected_gold string, action string, corrected_gold string")
    (r,) = filters.reviewed(rows, make(good), ()).collect()
    assert (r.gold, r.gold_original, r.action, r.reason) == ("4", "3", "gold_corrected", None)
    with pytest.raises(Exception, match="reviewed source changed"):
        filters.reviewed(rows, make("0"), ()).collect()


def test_annotations(spark):
    schema = "responses array<string>, extracted array<string>, correct array<boolean>, tokens array<long>, finish array<string>, num_correct long"
    good = (["r"] * 8, ["e"] * 8, [True] * 3 + [False] * 5, [1] * 8, ["stop"] * 8, 3)
    rows = [good, (*good[:5], 4), (["r"] * 7, *good[1:]), (None,) * 6, (None, *good[1:])]
    assert [r[0] for r in frame(spark, rows, schema).select(filters.valid_annotation()).collect()] == [True, False, False, True, False]


def test_selection_does_not_depend_on_order(spark):
    rows = spark.range(300).withColumn("s", F.concat(F.lit("s"), F.col("id") % 3))
    a = {r.id for r in select.ranked(rows, "s", F.col("id"), 10, 42).collect()}
    b = {r.id for r in select.ranked(rows.orderBy(F.desc("id")).repartition(7), "s", F.col("id"), 10, 42).collect()}
    assert a == b and len(a) == 30


def test_rewards(spark):
    rows = frame(spark, [(True, 16384), (True, 18432), (True, 20480), (False, 10)], "c boolean, n long")
    assert [r[0] for r in rows.select(metrics.reward(F.col("c"), F.col("n"), 16384, 20480)).collect()] == [1.0, 0.5, 0.0, -1.0]


def test_checks(spark):
    a = frame(spark, [(1, "x"), (2, None), (2, " ")], "k long, v string")
    assert [r.k for r in checks.duplicates(a, "k").collect()] == [2] and checks.missing(a, "v").count() == 2
    assert checks.differences(a, a).count() == 0 and checks.wrong_count(a, 2).count() == 1
    assert checks.changed(a.filter("k = 1"), a.filter("k = 1").withColumn("v", F.lit(None).cast("string")), "k", "v").count() == 1
    with pytest.raises(ValueError):
        checks.require(checks.wrong_count(a, 2), "rows")
    assert checks.lost(frame(spark, [("s", "kept", 2)], "source string, stage string, n long"), "source", frame(spark, [("s", 3)], "source string, n long")).count() == 1


def test_prompts(spark):
    one = spark.range(1)
    text = one.select(examples.choice_prompt(F.lit("Q?"), F.array(F.lit("x"), F.lit("N/A"), F.lit("y")))).first()[0]
    assert text == "Question:\nQ?\nOptions:\nA. x\nB. y\nAnswer: Let's think step by step."
    with pytest.raises(Exception, match="chat token"):
        one.select(examples.chat(F.lit("a"), F.lit("<|im_end|>"))).collect()
    with pytest.raises(Exception, match="unknown prompt wrapper"):
        one.select(examples.unwrapped(F.lit("else"), "Solve:")).collect()


def test_content_digest_counts_repeated_rows(spark):
    from pyspark.sql import functions as F

    from quarry.operators import checks

    def digest(rows):
        return tuple(checks.content_digest(spark.createDataFrame(rows, "k long, v string"), "k", F.col("v")).first())

    assert digest([(1, "a"), (1, "a")]) != digest([(2, "b"), (2, "b")]) != digest([(1, None), (1, None)])
    assert digest([(1, "a"), (2, "b")]) == digest([(2, "b"), (1, "a")]) != digest([(1, "b"), (2, "a")])
    assert digest([(1, None)]) != digest([(1, "")]) and digest([]) == digest([])


def test_config_differences():
    from quarry.operators.checks import config_differences

    assert config_differences({"a": 1, "b": [1, {"c": 2}]}, {"a": 1, "b": [1, {"c": 2}]}) == []
    assert config_differences({"a": 1, "b": [1, {"c": 2}], "x": 0}, {"a": 1.0, "b": [1, {"c": 3}], "y": 0}) == ["x: only in the first", "y: only in the second", "a: 1 is not 1.0", "b[1].c: 2 is not 3"]
    assert config_differences({"a": 1, "t": 2}, {"a": 1, "t": 3}, ignored=frozenset({"t"})) == []


def test_batch_schedule():
    from quarry.operators.pool import batch_schedule

    assert batch_schedule(10, 4, 3) == {"steps_per_epoch": 3, "steps": 9, "last_batch": 2} and batch_schedule(8, 4, 1)["last_batch"] == 4


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from quarry import session

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: {}), conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(far)
    assert session.scratch_dir(spark)


def test_latest_status_breaks_ties(spark):
    from quarry.streaming.journal import latest_status

    rows = [(1, 2, "a"), (1, 2, "b"), (1, 1, "z")]
    for own in (rows, rows[::-1]):
        assert [tuple(r) for r in latest_status(spark.createDataFrame(own, "id long, attempt int, status string"), "id", "attempt").collect()] == [(1, 2, "b")]


def test_near_links_with_common_ngrams(spark):
    """Over COMMON sets that share most of their n-grams, a set of common ones only, and short and empty texts."""
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base[:k] + [f"v{k}{j}" for j in range(30 - k)]) for k in range(30) for _ in range(2)]
    texts += [" ".join(base + [f"x{k}"]) for k in range(dedup.COMMON + 9)] + [" ".join(base), "a b", "a b", "", None, "a b c d e"]
    rows = frame(spark, list(enumerate(texts)), "id long, text string")
    forms = {}
    for i, t in enumerate(texts):
        w = (t or "").replace("w", "w ").replace("v", "v ").replace("x", "x ").split()
        forms.setdefault(" ".join(w), (i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}))
    sets = sorted(forms.values(), key=lambda x: x[0])
    for threshold in (0.5, 0.8):
        want = {(u, v) for n, (u, a) in enumerate(sets) for v, b in sets[n + 1 :] if len(a & b) / len(a | b) >= threshold}
        got = {(r.u, r.v): r.similarity for r in dedup.near_links(rows, 5, threshold).collect()}
        assert got.keys() == want and len(want) > 300


def test_literal_metadata(spark):
    texts = ["{'source': 'a', 'Level': 5, 'messages': 'x', 3: 4, 'type': None, 'id': [1, None]}", " {'year': 1}", "['source']", "{'source': f()}", "", None, "(" * 5000, "{'source': 'a'}", "{'source': 'a'}"]
    rows = frame(spark, [(i, t, "c") for i, t in enumerate(texts)], "id long, metadata string, _c string")
    got = {r.id: r.metadata for r in examples.literal_metadata(rows, "metadata").collect()}
    assert got == {0: {"source": "a", "Level": "5", "type": None, "id": "[1, null]"}, 1: {"year": "1"}, 2: {}, 3: {}, 4: {}, 5: {}, 6: {}, 7: {"source": "a"}, 8: {"source": "a"}}


def test_retry_after(spark):
    values = [None, "", "7", " 2.5 ", "1e2", "-4", "5d", "soon", "Thu, 01 Jan 2026 00:01:00 GMT", "Wed, 31 Dec 2025 00:00:00 GMT"]
    rows = frame(spark, [(v,) for v in values], "v string")
    got = [r.s for r in rows.select(T.retry_after(F.col("v"), F.lit("2026-01-01 00:00:30 UTC").cast("timestamp")).alias("s")).collect()]
    assert got == [0, 0, 7, 2.5, 100, 0, 0, 0, 30, 0]


def test_sampling_summary(spark):
    schema = "num_correct int, finish_reasons array<string>, response_tokens array<int>, extracted_answers array<string>, grading_errors array<string>"
    rows = frame(spark, [(0, ["stop", None], [3, None], ["", "a"], [None, "e"]), (8, ["stop"], [1], [""], [None]), (None, None, None, None, None), (1, None, None, None, None)], schema)
    got = {(r.metric, r.name): r.value for r in metrics.sampling_summary(rows, F.col("num_correct") < 3).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("source_rows", ""): 4, ("selected_rows", ""): 2, ("unselected_rows", ""): 2, ("responses", ""): 16, ("num_correct", "0"): 1, ("num_correct", "1"): 1,
        ("response_tokens", ""): 3, ("empty_extractions", ""): 1, ("grading_errors", ""): 1, ("finish_reasons", "stop"): 1, ("finish_reasons", "null"): 1,
    }
    assert sum(k[0] == "num_correct" for k in got) == 9
    assert metrics.sampling_summary(rows.limit(0), F.lit(True)).count() == 0


def test_crosstab_and_grades(spark):
    rows = frame(spark, [("a", True, 1), ("a", None, 1), ("b", False, 2), (None, True, None)], "k string, f boolean, p long")
    assert {tuple(r) for r in metrics.crosstab(rows, ["k"], ["f"]).collect()} == {("a", 1, 1), ("b", 0, 1), (None, 1, 0)}
    assert {tuple(r) for r in metrics.grade_counts(rows, ["k"], "p").collect()} == {("a", 2, 1), ("b", 1, 1), (None, 1, 0)}


def test_completion_budgets_of_a_table_with_long_and_null_texts(spark, tmp_path):
    from quarry.plans import catalog

    texts = [(1, "a"), (2, "x" * 36000), (3, "x" * 40000), (4, "x" * 122698), (5, None)]
    frame(spark, texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.budget for r in catalog.QUERIES["completion_budgets"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(duck.execute(catalog.ORACLES["completion_budgets"]).fetchall()) == {1: 4096, 2: 4000, 3: 0, 4: -82698, 5: 4096}


def test_no_room_is_an_error_where_it_is_asked_for(spark):
    own = frame(spark, [(1, 10), (2, 100)], "id long, prompt int")
    budget = examples.has_room(examples.completion_budget(F.col("prompt"), 100, 50))
    assert own.filter("id = 1").select(budget).first()[0] == 50
    with pytest.raises(Exception, match="no room"):
        own.select(budget).collect()


def test_near_links_in_slices_move_shared_ngrams_only(spark, monkeypatch):
    """Slices change no link, and an n-gram that one set alone has is never a key."""
    monkeypatch.setattr(dedup, "SLICE", 40)
    own = lambda k, n: [f"{chr(97 + k)}{chr(97 + j)}" for j in range(n)]
    texts = [" ".join(own(k, 20)) for k in range(10)] + [" ".join(own(k, 18) + ["zz", "zy"]) for k in range(3)] + ["", None, "q"]
    forms = dedup._forms(frame(spark, list(enumerate(texts)), "id long, text string"), 5, T.normal_lexical)
    got = {(r.u, r.v): round(r.similarity, 9) for r in dedup._links(forms, 0.5).collect()}
    assert got == {(k, 10 + k): round(14 / 18, 9) for k in range(3)}
    sets = forms.filter("id < 14").select("id", F.size("grams").alias("size"), "grams")
    held = dedup._held(sets)
    assert {(r.id, r.size, len(r.held)) for r in held.collect()} == {(k + d, 16, 14) for k in range(3) for d in (0, 10)}
    keys = dedup._prefixes(held, 0.5).collect()
    assert {r.id for r in keys} == {0, 1, 2, 10, 11, 12} and {r["at"] for r in keys} == set(range(2, 9))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_links_send_a_set_to_a_block_once(spark, monkeypatch, kind):
    """A family of near copies makes a row for a set and a block, not for each pair, and loses no link; also where blocks and
    chunks are small, a row is repeated, ids are text, and the sets without links are left out halfway."""
    for name, value in {"SLICE": 4000, "BLOCK": 16, "CHUNK": 300, "DENSE": 3, "WIDE": 32}.items():
        monkeypatch.setattr(dedup, name, value)
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    base = [f"w{letters(k)}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"x{letters(k)}"] + base[k + 1 :]) for k in range(60)]  # one word differs
    texts += [" ".join(base[:k] + [f"y{letters(j)}z{letters(k)}" for j in range(60 - k)]) for k in range(20, 60)]  # all from k on
    texts += [" ".join(f"v{letters(k)}u{letters(j)}" for j in range(40)) for k in range(80)]  # no copies
    ids = [k if kind == "long" else f"d{k:03d}" for k in range(len(texts))]
    rows = frame(spark, [*zip(ids, texts, strict=True), (ids[3], texts[3]), (ids[179], texts[3])], f"id {kind}, text string")
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in zip(ids, texts, strict=True)]
    for threshold in (0.5, 0.8):
        want = {(u, v): len(a & b) / len(a | b) for n, (u, a) in enumerate(sets) for v, b in sets[n + 1 :] if len(a & b) / len(a | b) >= threshold}
        found = dedup.near_links(rows.filter(~((F.col("id") == ids[179]) & (F.col("text") == texts[3]))), 5, threshold)
        got = [(r.u, r.v, r.similarity) for r in found.collect()]
        assert len(got) == len(want) > 300 and {(u, v): s for u, v, s in got} == want
        own = dedup._numbered(dedup._forms(rows, 5, T.normal_lexical))
        held = dedup._held(dedup._distinct(own), threshold)
        assert {r.id for r in held.collect()} <= set(ids[:100])
        blocks = dedup._blocks(held, threshold)
        n = blocks.select("block").distinct().count()
        assert blocks.groupBy("block").count().filter(f"count > {dedup.BLOCK}").count() == 0
        assert dedup._guests(blocks, threshold).count() <= 100 * (n - 1) and n < 40
