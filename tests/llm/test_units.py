"""Plain functions of the training-text operators, without a session."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lekhani.llm import mixing, packing, pairs, residue, sentences


def cut(text):
    return [text[a - 1 : a - 1 + n] for a, n in sentences.units(text)]


def test_spaced_scripts():
    assert cut("Dr. Ada came at 5 p.m. She left. The 4 p.m. boat was late.") == ["Dr. Ada came at 5 p.m.", "She left.", "The 4 p.m. boat was late."]
    assert cut("Was it No. 11 or No. 7? R. K. Bose & Co. refused.") == ["Was it No. 11 or No. 7?", "R. K. Bose & Co. refused."]
    assert cut("He paused... and sang. The toll (3.5 annas, i.e. half.) was paid.") == ["He paused... and sang.", "The toll (3.5 annas, i.e. half.) was paid."]
    assert cut("It rained.The boat left.") == ["It rained.", "The boat left."]
    assert cut("डॉ. राम आए। वे चुप रहे... फिर बोले। कितनी रात!") == ["डॉ. राम आए।", "वे चुप रहे... फिर बोले।", "कितनी रात!"]
    assert cut("খণ্ড ২, পৃ. ৫ দেখো। সে গেল ।") == ["খণ্ড ২, পৃ. ৫ দেখো।", "সে গেল ।"]


def test_quotations_join_their_report():
    assert cut("“I will not go. It is late!” cried Ada, and left. Rain fell.") == ["“I will not go. It is late!” cried Ada, and left.", "Rain fell."]
    assert cut("“Open the gate!” Ada hid the key. “Enough!” Ada said.") == ["“Open the gate!”", "Ada hid the key.", "“Enough!” Ada said."]
    assert cut("「静かに！」「港まで聞こえる。」と二人はささやいた。「開けろ！」嵐が来た。") == ["「静かに！」「港まで聞こえる。」と二人はささやいた。", "「開けろ！」", "嵐が来た。"]


def test_spaceless_gaps():
    assert cut("彼は鐘を待っていた……船が出た。彼は……何も言わなかった。") == ["彼は鐘を待っていた……", "船が出た。", "彼は……何も言わなかった。"]
    assert cut("来るのか！？重さは3.5斤だった。") == ["来るのか！？", "重さは3.5斤だった。"]


def test_lines_numbers_and_separators():
    assert cut("## Chapter 1\n\n***\n1. The boat left. Rain fell.\n— copied, year 3") == ["## Chapter 1", "1. The boat left.", "Rain fell.", "— copied, year 3"]
    assert cut(None) == cut("") == cut(" \n　") == []
    assert cut("The boat lef") == ["The boat lef"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?\n“”「」。…(),1", max_size=60))
def test_units_are_ordered_trimmed_and_cover_all_words(text):
    at, covered = 0, set()
    for start, n in sentences.units(text):
        piece = text[start - 1 : start - 1 + n]
        assert start - 1 >= at and piece == piece.strip() and "\n" not in piece and n > 0
        at = start - 1 + n
        covered.update(range(start - 1, at))
    assert all(i in covered for i, ch in enumerate(text) if ch.isalnum())


def test_very_long_text_is_read_whole():
    assert len(sentences.units("The boat left. " * 20_000)) == 20_000


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_subsequence_matches_brute_force(a, b):
    assert pairs.common_length(a, b) == brute_lcs(a, b)


def test_defects():
    q = "Who opened the gate for Ada?"
    case = lambda lang, r, p=q, known=False: pairs.defect(lang, p, r, known)
    assert [case("en", r) for r in (None, "", " ​", "N/A", "(none)", "।", '""')] == ["empty"] * 7
    assert [case("en", r) for r in (q, "“Who opened the gate for Ada”", "Question: Who opened the gate for Ada?", "who opened the gate for ada")] == ["copied"] * 4
    assert [case("en", r) for r in ("I cannot help with this request about Ada.", "The provided text does not mention it, so no answer can be given.")] == ["refusal"] * 2
    assert case("en", "Who opened the gate for Ada? Bose.") is None
    assert case("en", "Bose told Ada, “I cannot answer that,” and left the town.") is None
    assert case("en", "Bose was sorry and could not help Ada find the key.") is None
    assert case("en", "Es war Bose, der das Tor für Ada öffnete.") == case("en", "門を開けたのはボセだ。") == "other_language"
    assert case("en", "Bose opened the gate (গেট).") is None
    assert case("ja", "ボセは門を開", "誰が門を開けたか？") == case("en", "Bose opened the ga") == case("en", "Bose forgave Ada and, and the") == "truncated"
    assert [case("en", r) for r in ("Bose", "the key", "12", "Bose opened the gate.")] == [None] * 4
    assert case("ja", "ボセ", None) is None


def test_residue_features():
    bucket = residue.Hasher()
    sure = lambda t: any(residue.read(t, bucket)[2])
    assert all(map(sure, ["Dear {{name}}, hello.", "He sold %s bales.", "Please enable JavaScript to view this page.", "404 Not Found", "lorem ipsum dolor", "bla bla bla bla", "undefined left the town."]))
    assert not any(map(sure, ["Use `{{gap}}` for a pause.", "He wrote “Access denied” on the wall.", "She counted 404 steps.", "Access to the fort was denied to Ada.", ""]))


def test_patterns_and_fit():
    rows = packing.patterns(10, 3)
    want = {tuple(sorted(c, reverse=True)) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(1, 11), n) if sum(c) == 10}
    assert {tuple(x for x in r if x) for r in rows.tolist()} == want and len(rows) == len(want)
    histogram = np.zeros(packing.BINS + 1, dtype=np.int64)
    histogram[[96, 64, 32]] = [50, 100, 50]
    used = sum((uses * times for uses, times in packing.fit(histogram)), np.zeros(packing.BINS + 1, dtype=np.int64))
    assert (used == histogram).all()
    assert packing.fit(np.zeros(packing.BINS + 1, dtype=np.int64)) == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=40))
def test_best_fit_keeps_capacity(sizes):
    containers = packing.best_fit(np.array(sizes), 20)
    loads = np.bincount(containers, weights=sizes)
    assert loads.max() <= 20 and sum(loads) == sum(sizes)
    assert len(loads) <= 2 * max(1, -(-sum(sizes) // 20))


def test_water_filling():
    have, share, caps = {"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 1}
    total = mixing.largest_total(have, share, caps)
    assert round(total, 6) == round(20 / 0.3, 6)
    assert {k: round(v, 6) for k, v in mixing.fill(have, share, caps, total).items()} == {"a": round(total * 0.5, 6), "b": 20.0, "c": round(total * 0.2, 6)}
    # beyond it the clamped source's weight goes to the others in proportion
    got = mixing.fill(have, share, caps, 120.0)
    assert got["b"] == 20.0 and abs(got["a"] / got["c"] - 2.5) < 1e-9 and abs(sum(got.values()) - 120) < 1e-6
    assert sum(mixing.fill(have, share, caps, 1e9).values()) == 100 + 20 + 1000
    assert mixing.fill({}, share, caps, 0.0) == dict.fromkeys("abc", 0.0)


def test_held_out_accuracy_of_sentences():
    random.seed(3)
    pool = ["Ada left the town.", "“Enough!” Bose said.", "Dr. Ada paid 3.5 annas.", "It was late... and dark.", "Was it No. 3?", "They met at 5 p.m."]
    for _ in range(50):
        chosen = random.choices(pool, k=8)
        assert cut(" ".join(chosen)) == chosen


def test_spaceless_gaps_without_marks():
    assert cut("門を開けたそして川へ行ったしかし誰もいなかった") == ["門を開けた", "そして川へ行った", "しかし誰もいなかった"]
    assert cut("「門を開けたそして泣いた」と言った。") == ["「門を開けたそして泣いた」と言った。"]
    assert cut("静かな夜である……そして朝が来た。") == ["静かな夜である……", "そして朝が来た。"]
    assert cut("アダの……そして鍵は。") == ["アダの……そして鍵は。"]


def test_refusals_align_and_function_words_open_texts():
    said = ["That is beyond what I can discuss.", "Nobody in the text says that.", "I’m unable to tell from these chapters.", "There is no mention of it in the passage.", "Unfortunately the passage gives no information on this."]
    assert {pairs.defect("en", "Who left?", t) for t in said} == {"refusal"}
    told = ["Bose was sorry and could not help Ada find the key.", "The messenger refused to answer.", "Ada said “I cannot answer that” and left.", "Nobody in the town said a word."]
    assert {pairs.defect("en", "Who left?", t) for t in told} == {None}
    assert {pairs.defect("en", "Where?", t) for t in ("La lampe.", "Zum Fluss.")} == {"other_language"} and pairs.defect("en", "Where?", "The lamp.") is None
