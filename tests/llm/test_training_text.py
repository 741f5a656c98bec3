"""The training-text operators on small tables with nulls, blanks, ties, repeats, odd columns and no rows."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lekhani.llm import alignment, lookalike, mixing, packing, pairs, residue, sentences, tokens, truncation


def test_lookalikes(spark):
    rows = [(1, "রাজা", "Ra", None, ""), (2, "রা​জা ", "Rа", None, " "), (3, "ব়াজা", "ra", None, None), (4, "রজা", "Rá", None, None), (5, None, None, None, None), (6, "রাজা", None, None, None)]
    terms = spark.createDataFrame(rows, "term_id long, bengali string, english string, hindi string, japanese string").withColumn("canonical", F.lit("clash")).withColumn("value", F.lit(1))
    work = spark.createDataFrame([(10, "Bengali (classical)", {"রাজা": "Raja", "": "x"}), (10, "Bengali", {"রাজা": "Raja"}), (11, "English", {"Ra ": "x"}), (12, None, {"রাজা": "x"}), (13, "Bengali", None)], "work_id long, source_lang string, proper_nouns map<string,string>")
    got = {tuple(r) for r in lookalike.same_looking(terms, work).collect()}
    assert {g for g in got if g[0] == "term_term"} == {("term_term", a, b) for a, b in ((1, 2), (1, 3), (2, 3), (2, 6), (3, 6))}
    assert {g for g in got if g[0] == "work_term"} == {("work_term", 10, 2), ("work_term", 10, 3), ("work_term", 11, 1), ("work_term", 11, 2)}
    assert lookalike.same_looking(terms.limit(0), work.limit(0)).count() == 0
    unified = lookalike.unify(terms.select("term_id", "bengali"), "bengali").collect()
    assert {r.canonical for r in unified if r.term_id in (1, 2, 3, 6)} == {"রাজা"} and len(unified) == 6


def test_display_keys(spark):
    same = [("Ｋａ（２）", "Ka(2)"), ("ｶﾞｰ", "ガー"), ("শ্রী  জুমি", "শ্রী জুমি"), ("ত্‍", "ৎ"), ("ミ八―", "ミハー"), ("Ⅱ", "II")]
    other = [("Ka", "ka"), ("ta", "tā"), ("ৎ", "ত্"), ("ন", "ণ"), ("ヤ", "ャ"), ("カ", "ガ")]
    key = F.collate(lookalike.display_key(F.col("a")), "UNICODE") == F.collate(lookalike.display_key(F.col("b")), "UNICODE")
    assert all(r[0] for r in spark.createDataFrame(same, "a string, b string").select(key).collect())
    assert not any(r[0] for r in spark.createDataFrame(other, "a string, b string").select(key).collect())


def test_pairs(spark):
    rows = [("q", 1, "en", "Who left?", None), ("q", 2, "en", None, "the oar"), ("q", 3, "en", None, "The oar."), ("q", 3, "en", None, "The oar."), ("e", 4, None, None, ""), ("e", 5, "en", "x", "Ada hid the oar un" + "der" * 5000)]
    df = spark.createDataFrame(rows, "table_name string, row_key long, lang string, prompt string, response string").withColumn("known", F.lit(1)).withColumn("bare", F.lit(1))
    assert sorted(tuple(r) for r in pairs.find_defects(df, "table_name", "row_key").collect()) == [("e", 4, "empty"), ("e", 5, "truncated"), ("q", 1, "empty")]
    assert pairs.find_defects(df.limit(0), "table_name", "row_key").count() == 0


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, " ")], "rec_id long, t string").withColumn("n_chars", F.lit(0))
    assert sorted(tuple(r) for r in sentences.sentence_units(df, "t", "rec_id").collect()) == [(1, 1, 4), (1, 1, 4), (1, 6, 4), (1, 6, 4)]
    assert sentences.sentence_units(df.limit(0), "t", "rec_id").count() == 0


def _stories(n, seed):
    random.seed(seed)
    names, things = ["Ada", "Bose", "Tara", "Omi", "Reva", "Nila"], ["oar", "bell", "ring", "map", "seal"]
    return [" ".join(f"{random.choice(names)} hid the {random.choice(things)} under the floor of {random.choice(names)}." for _ in range(random.randint(2, 9))) for _ in range(n)]


def test_truncation_finds_limits_and_lost_ends(spark):
    rows = [(i, "whole", t) for i, t in enumerate(_stories(150, 1))]
    rows += [(1000 + i, "limited", t[:120]) for i, t in enumerate(_stories(150, 2))]
    stories = _stories(60, 3)
    rows += [(2000 + i, "lossy", t[: len(t) - 9] if i % 3 == 0 else t) for i, t in enumerate(stories)]
    rows += [(3000, "whole", None), (3001, "whole", " 　"), (3002, "whole", rows[0][2])]
    df = spark.createDataFrame(rows, "rec_id long, run_name string, translation string").withColumn("source", F.lit("clash")).withColumn("value", F.lit("clash"))
    values = truncation.fields(df, {"translation": F.col("translation")}, "rec_id", "run_name")
    cut = {r.rec_id for r in truncation.find_cut(values, "rec_id").where("is_cut").collect()}
    want = {i for i, s, t in rows if t and (s == "limited" and len(t) == 120 and not t.endswith(".") or s == "lossy" and i % 3 == 2000 % 3 and not t.endswith("."))}
    want |= {2000 + i for i in range(0, 60, 3)}
    assert len(cut & want) / len(want) > 0.95 and len(cut - want) == 0
    share = {r.run_name: r for r in truncation.shares(truncation.find_cut(values, "rec_id"), "run_name").collect()}
    assert share["whole"].n_cut == 0 and share["whole"].n_values == 151
    empty = truncation.fields(df.limit(0), {"translation": F.col("translation")}, "rec_id", "run_name")
    assert truncation.find_cut(empty, "rec_id").count() == 0


def test_alignment_recovers_shuffled_lines(spark):
    random.seed(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    other = {w: "".join(chr(0x30A1 + (ord(c) - 97) * 3) for c in w[1:]) + "ン" for w in words}
    rows, want, rec = [], set(), 0
    for s in range(60):
        events = [random.sample(words, 5) for _ in range(6)]
        order = random.sample(range(6), 5)  # one is dropped, the rest move
        rec += 2
        rows.append((s, rec, "English", "\n".join(" ".join(e) for e in events)))
        rows.append((s, rec + 1, "Japanese", "\n\n".join("は".join(other[w] for w in events[k]) for k in order)))
        want |= {(rec, k + 1, rec + 1, place + 1) for place, k in enumerate(order)}
    rows += [(900, 9000, "English", None), (900, 9001, "Japanese", "\n"), (901, 9002, "English", "wa wb")]
    df = spark.createDataFrame(rows, "segment int, rec_id long, target_lang string, t string").withColumn("line", F.lit(1)).withColumn("lo", F.lit(1))
    got = {(r.lo, r.line_lo, r.hi, r.line_hi) for r in alignment.align(df, ["segment"], "rec_id", "target_lang", "t").collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    assert alignment.align(df.limit(0), ["segment"], "rec_id", "target_lang", "t").count() == 0


def test_packing_round_trip(spark):
    random.seed(7)
    lengths = [(i, random.choice([0, 3, 40, 60, 64, 100, 130, 400])) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens int").withColumn("size_id", F.lit(9)).withColumn("bin", F.lit(9))
    sizes = spark.createDataFrame([(1, "s", 128), (2, "l", 512)], "size_id int, size_name string, capacity_tokens int")
    packed = packing.pack(df, "doc_id", sizes).collect()
    for size_id, capacity in ((1, 128), (2, 512)):
        loads, parts = defaultdict(int), defaultdict(list)
        for r in packed:
            if r.size_id == size_id:
                loads[r.container] += r.n_tokens
                parts[r.doc_id].append((r.start_token, r.n_tokens))
        assert max(loads.values()) <= capacity
        for doc, n in lengths[:-1]:
            at = 0
            for start, part in sorted(parts[doc]):
                assert start == at
                at += part
            assert at == n and (len(parts[doc]) == 1 or n > capacity)
        assert len(loads) <= 1.08 * -(-sum(n for _, n in lengths[:-1]) // capacity) + 2
    assert packing.pack(df.limit(0), "doc_id", sizes).count() == 0 and packing.pack(df, "doc_id", sizes.limit(0)).count() == 0


def test_mixture_reaches_its_shares(spark):
    random.seed(9)
    rows = [(i, random.choices(["a", "b", "c"], [70, 25, 5])[0], random.randint(1, 9)) for i in range(4000)] + [(9998, None, 5), (9999, "unlisted", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").withColumn("whole", F.lit(1)).withColumn("h", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("missing", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(df, targets, "doc_id")
    got = {r.source: r for r in shares.collect()}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s].reached_share - w / 0.95) < 0.005
    assert got["missing"].tokens_used == 0
    caps = {"a": 1, "b": 2, "c": 4}
    rows = mixture.collect()
    assert all(0 < r.repeats <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df, targets, "doc_id")[0].collect()))
    assert mixing.mix(df.limit(0), targets, "doc_id")[0].count() == 0 and mixing.mix(df, targets.limit(0), "doc_id")[0].count() == 0


def test_residue_held_out(spark):
    good = [(i, t) for i, t in enumerate(_stories(200, 11))] + [(500, "Use `{{gap}}` to indent."), (501, "The old viewer asked visitors to enable JavaScript; the new one doesn't."), (502, None), (503, "")]
    bad = [(1000 + i, f"{t}\n{x}") for i, (t, x) in enumerate(zip(_stories(60, 12), ["Please enable JavaScript.", "Error 404: Not Found.", "Ada met {{name}} at the well."] * 20, strict=True))]
    bad += [(2000, "Lorem ipsum dolor vixit amet nulla plena."), (2001, "Lorem ipsum nulla amet dolor."), (2002, "Nulla amet dolor plena vixit.")]
    df = spark.createDataFrame(good + bad, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("score", F.lit(1))
    got = [r.doc_id for r in residue.find_residue(df, "doc_id", "text").collect()]
    assert set(got) == {k for k, _ in bad} and len(got) == len(bad)
    assert residue.find_residue(df.limit(0), "doc_id", "text").count() == 0


def test_token_counts(spark):
    from pathlib import Path

    if not Path(tokens.RANKS).exists():
        pytest.skip("no public tokenizer here")
    df = spark.createDataFrame([(1, "the boat"), (2, ""), (3, None), (4, "<|endoftext|> " * 50)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "text", "doc_id").collect()}
    assert got[1] >= 2 and got[2] == 0 and 3 not in got and got[4] > 100


def test_residue_finds_what_no_sign_was_given_for(spark):
    random.seed(13)
    calls = [f"{a} {b}{c}." for a in ("Please", "Kindly", "You need to", "To read on,") for b in ("enable scripts", "allow cookies", "switch on scripting", "disable your blocker") for c in ("", " and reload", ", then try again")]
    held = [f"Ada hid the oar under the floor of {x}." for n in ("name", "place", "item", "number") for x in (f"{{{{{n}}}}}", f"<{n}>", f"@@{n}@@", f"__{n.upper()}__")]
    stories = [f"{random.choice(['Ada', 'Bose', 'Tara'])} hid the {random.choice(['oar', 'bell', 'ring'])} under the floor of {random.choice(['Omi', 'Reva'])}. {'The drum [a small dhol] was shut away.' if i % 20 == 0 else 'The gate of MAGI was shut.'}" for i in range(600)]
    rows = [(i, t) for i, t in enumerate(stories)] + [(10_000 + i, t) for i, t in enumerate((calls + held) * 2)]
    only = lambda passage, is_group: passage.startswith(("{{", "<")) if is_group else passage.startswith("please")
    got = {r.doc_id for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", only).collect()}
    want = {k for k, _ in rows if k >= 10_000}
    unseen = {k for k, t in rows if k >= 10_000 and not t.startswith("Please") and "{{" not in t and "<" not in t}
    assert not got - want and len(got & unseen) / len(unseen) >= 0.9


def test_mixture_walks_past_large_documents(spark):
    rows = [(0, "a", 9000), *((i, "a", 90 + i) for i in range(1, 21)), *((100 + i, "b", 50) for i in range(200)), (100, "b", 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.4, 4), ("b", 0.6, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(df, targets, "doc_id")
    got = {r.source: r for r in shares.collect()}
    assert abs(got["a"].reached_share - 0.4) < 0.01 and got["a"].most_repeats == 4 and 0 not in {r.doc_id for r in mixture.collect()}
    assert sum(r.n_tokens * r.repeats for r in mixture.collect() if r.source == "b") <= 50 * 201
    # beyond the caps: b is clamped, a takes what b lacks
    filled = {r.source: r for r in mixing.mix(df, targets, "doc_id", math.inf)[1].collect()}
    assert filled["b"].tokens_used == 50 * 201 and abs(filled["a"].planned_share + filled["b"].planned_share - 1) < 1e-9


def test_packing_fills_bundles(spark):
    random.seed(8)
    df = spark.createDataFrame([(i, random.randint(5, 60)) for i in range(4000)], "doc_id long, n_tokens int").withColumn("level", F.lit(1)).withColumn("capacity", F.lit(1))
    sizes = spark.createDataFrame([(1, "l", 2048)], "size_id int, size_name string, capacity_tokens int")
    packed = packing.pack(df, "doc_id", sizes)
    row = packing.unused(packed, sizes).first()
    assert row.pattern_share > 0.8 and row.unused_share < 0.03
    assert packed.count() == 4000 and packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0
