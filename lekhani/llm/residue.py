"""Documents that hold template leftovers, filler, or messages of failing and refusing pages.

Method: positive-unlabelled naive Bayes, fitted by expectation maximisation from trusted error and
placeholder records, which then scores passages; a document is reported when one of its passages is more
likely positive than not. Every report comes from the model's odds, those of trusted passages too.

Passages are sentences, without their code spans and quotations, because text that quotes such a thing is
no case, and within the sentences each group of marks (``{{x}}``, ``%s``, ``___``, ``NaN``) is a passage of
its own, so that the ordinary words around it don't outweigh it. Each class is a distribution of features
within one script, or among the groups of marks; a script that has more cases than another thus says
nothing. What is trusted counts whole, what the model finds counts a part of it (else a frequent topic
could take the class over). Sentences start as negative, groups of marks as undecided. The
prior of a passage is estimated apart for records with and without another positive passage.

Features are hashed into a fixed number of buckets, so the model is an array of a known size. Each round is
one pass over all passages; the driver gets the expected counts of each bucket, and rounds go on until the
expected number of cases is steady.

Null and empty texts are no cases, repeated texts count each, an empty table gives an empty result, texts of
any length are read whole, odds of exactly 1 are no case, further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhani.session import cut_lineage

#: Buckets of the hashed features; the highest GROUP_BITS of a bucket's number are its group (scripts, marks).
BUCKETS, GROUP_BITS = 1 << 21, 3
GROUP_SIZE = BUCKETS >> GROUP_BITS
LATIN, KANA, DEVANAGARI, BENGALI, MARKS, OTHER = range(6)
#: Share of the common distribution in each class; weight of the sentences and of the groups of marks that the model finds; log-odds above which a document is a case.
COMMON, FOUND, FOUND_MARKS, LEAST_ODDS = 0.005, 0.1, 1.0, 0.0
#: Rounds end when the expected number of cases changes by less than this share; after so many they fail.
STEADY, MOST_ROUNDS = 0.002, 200

_ABBREVIATIONS = "".join(rf"(?<!\b{w}\.)" for w in "Dr Mr Mrs St Mt No no ch vol Co [A-Z] डॉ पं पृ ডা মো পৃ".split())
SPLIT = re.compile(rf"\n+|(?<=[.!?])(?<!\.\.){_ABBREVIATIONS}[\"”’)]*\s+(?![a-z])|(?<=[。！？।৷])[\s　\"”’」』）)]*")
QUOTED = re.compile(r"`[^`\n]*`|“[^”\n]*”|「[^」\n]*」|『[^』\n]*』|‘[^’\n]*’|«[^»\n]*»")
WORD = re.compile(r"[a-zà-ɏ̀-ͯ]+|[ऀ-ॣ॰-ॿ]+|[ঀ-৥ৰ-৾]+|[゠-ヿ]+|[぀-ゟ一-鿿]+|[45]\d\d(?!\d)")
REPEATED = re.compile(r"(\S{2,}(?: \S{2,})?)(?:[ 　]+\1){2,}")
# Groups of marks: what brackets or signs enclose, signs at a word, blanks to fill in, words of odd spelling. The
# names of markup elements are no such group.
ELEMENTS = "html|head|body|title|h[1-6]|p|br|hr|div|span|b|i|em|strong|a|ul|ol|li|table|tr|td|sup|sub|ref|poem"
GROUP = re.compile(
    rf"[$#%@]*(?:\{{+[^{{}}\"\n]*\}}+|<+(?!/|(?:{ELEMENTS})\b)[^<>\n]*>+|\[+[^\[\]\n]*\]+)"
    r"|([@#$%|_])\1*[^\W_]+(?:_[^\W_]+)*\1+"
    r"|[$%#@~^\\|]+\(?[^\W\d_][A-Za-z0-9_]*\)?[A-Za-z0-9_!?/]*|_{2,}|＿{2,}"
    r"|(?<![\w'’.-])(?:[A-Z]{3,}|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*|undefined|null|nil|None|N/A)(?![A-Za-z0-9'’_-])"
)
MAYBE_GROUP = re.compile(r"[{<\[$%#@_＿~^\\|]|[a-z][A-Z]|[A-Z]{3}|undefined|null|nil|None|N/A")

# Signs of trusted records, of messages and of filler: how a passage begins, what it holds together with a
# word that is looked for first, and stems in other scripts.
TRUSTED_START = re.compile(
    r"(?:please|kindly|you need)\b.*\b(?:javascript|scripts?|scripting|cookies?)\b|(?:the|this) page\b.*\bnot\b|(?:the )?connection was\b|we (?:can[’']t|cannot|could not)\b|access denied|your session|traceback"
    r"|\W*error\W*\b(?:code\b|\{)|(?:lorem ipsum|todo|coming soon)\b|(?:dummy|sample|body|filler|placeholder) (?:text|line|paragraph|sentence)\b"
)
TRUSTED_WITHIN = [
    (word, re.compile(pattern))
    for word, pattern in (
        ("not found", r"\b4\d\d:? not found\b"), ("forbidden", r"\b4\d\d:? forbidden\b"), ("too many", r"\b4\d\d:? too many requests\b"), ("bad gateway", r"\b5\d\d:? bad gateway\b"),
        ("internal", r"\b5\d\d:? internal server error\b"), ("unavailable", r"\b5\d\d:? service unavailable\b"), ("timeout", r"\b5\d\d:? gateway timeout\b"),
        ("browser", r"\bbrowser\W*$"), ("to be ", r"\bto be (?:written|added)\b"), ("quota", r"\bquota\b"), ("to follow", r"\b(?:translation|text) to follow\b"),
    )
]
TRUSTED_STEMS = (
    "javascript cookie ブラウザ ページは ページを表示 ログイン スクリプトが サーバーが エラーが 接続 削除された ダミー 本文が入 後で記入 ब्राउज़र सत्र स्क्रिप्ट सर्वर संपर्क ব্রাউজার স্ক্রিপ্ট সার্ভার সংযোগ নমুনা".split()
    + ["पृष्ठ नहीं", "पृष्ठ को", "हटा दिया", "यहाँ पाठ", "नमूना पाठ", "बाद में जोड़ा", "পাতাটি খুঁজে পাওয়া যায়নি", "লগ ইন", "মুছে ফেলা", "এখানে লেখা", "পরে যোগ"]
)
# Trusted groups of marks, placeholders and empty values.
TRUSTED_GROUP = re.compile(r"\{\{.*\}\}$|\$\{.*\}$|%[sd]$|_{3,}$|\[object Object\]$|(?:undefined|NaN|#[A-Z]+!)$|\[(?:insert|यहाँ|এখানে|ここ)")

Trust = Callable[[str, bool], bool]


def trusted(passage: str, is_group: bool) -> bool:
    """Whether a passage of lower case, or a group of marks, is a sure sign."""
    if is_group:
        return bool(TRUSTED_GROUP.match(passage))
    if TRUSTED_START.match(passage) or REPEATED.match(passage) or any(word in passage and pattern.search(passage) for word, pattern in TRUSTED_WITHIN):
        return True
    return max(passage) > "\u0900" and any(stem in passage for stem in TRUSTED_STEMS)


def passages(text: str) -> list[str]:
    return [p for p in (s.strip(" \t\r　\"”’」』）)-*•") for s in SPLIT.split(QUOTED.sub(" ", text))) if p]


def script(word: str) -> int:
    c = word[0]
    return LATIN if c < "ऀ" else DEVANAGARI if c < "ঀ" else BENGALI if c < "਀" else KANA if "぀" <= c <= "鿿" else OTHER


class Words(dict):
    """Script and features of a word, pairs of characters for spaceless script; the table is emptied before it grows large."""

    def __missing__(self, w: str) -> tuple[int, list[str]]:
        if len(self) > 200_000:
            self.clear()
        if w[0].isdigit():
            own = (-1, ["#code"])
        elif (s := script(w)) == KANA and not "゠" <= w[0] <= "ヿ":
            own = (s, [w] if len(w) == 1 else [w[i : i + 2] for i in range(len(w) - 1)])
        else:
            own = (s, [w])
        self[w] = own
        return own


KNOWN_WORDS = Words()


def word_features(low: str) -> tuple[list[str], int]:
    """Words of a sentence in lower case, and its script: of most words that aren't Latin, if there are any."""
    out, counts = [], [0] * 7
    for w in WORD.findall(low):
        s, own = KNOWN_WORDS[w]
        counts[s] += len(w)
        out += own
    if REPEATED.match(low):
        out.append("#repeat")
    rest = max(counts[1:6])
    return out, counts.index(rest, 1) if rest else LATIN


def group_features(group: str) -> list[str]:
    """The signs that open and close a group of marks and the words within; the shape of an odd word."""
    out = ["w" + w for w in re.findall(r"[^\W\d_]+", group.lower())]
    first, last = re.match(r"[^\w\s]+|_+|＿+", group), re.search(r"(?:[^\w\s]+|_+|＿+)$", group)
    if first and first[0] != "[":  # a single square bracket is one of prose, too
        out.append("o" + first[0][:4])
    if last and last[0] != "]":
        out.append("c" + last[0][-4:])
    if len(set(group)) == 1:
        out.append("same")
    elif not first:
        out.append("s" + re.sub(r"[a-zà-ɏ]+", "a", re.sub(r"[A-Z]+", "A", group)))
    return out


class Hasher(dict):
    """Bucket of a (group, feature); the table is emptied before it grows large."""

    def __missing__(self, key: tuple[int, str]) -> int:
        if len(self) > 400_000:
            self.clear()
        self[key] = h = key[0] * GROUP_SIZE + zlib.crc32(key[1].encode()) % GROUP_SIZE
        return h


def read(text: str, bucket: Hasher, trust: Trust = trusted) -> tuple[list[int], list[int], list[bool]]:
    """Buckets of all passages in one list, their number in each passage, and whether it is trusted."""
    buckets, sizes, sure = [], [], []

    def add(group: int, features: list[str], is_sure: bool) -> None:
        own = {bucket[group, f] for f in features}
        if own:
            buckets.extend(sorted(own))
            sizes.append(len(own))
            sure.append(is_sure)

    for passage in passages(text):
        if MAYBE_GROUP.search(passage):
            for m in GROUP.finditer(passage):
                add(MARKS, group_features(m[0]), trust(m[0], True))
        # headings and bracketed closing notes are structure, not words of a message
        if passage[0] != "#" and not (passage[0] in "[【" and passage[-1] in "]】"):
            low = passage.lower()
            features, group = word_features(low)
            add(group, features, trust(low, False))
    return buckets, sizes, sure


def encode(df: DataFrame, key: str, text: str, trust: Trust = trusted) -> DataFrame:
    """``key, buckets, sizes, sure``: the passages of each document as feature buckets.

    Written once to the shared checkpoint folder, for every round reads them again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Hasher()
        for batch in batches:
            made = [read(value, bucket, trust) for value in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "buckets": [m[0] for m in made], "sizes": [m[1] for m in made], "sure": [m[2] for m in made]})

    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return cut_lineage(rows.mapInPandas(run, f"key {kind}, buckets array<int>, sizes array<int>, sure array<boolean>"))


class Passages:
    """The passages of one Arrow batch as flat arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        self.buckets, self.sizes, self.sure = flat("buckets"), flat("sizes"), flat("sure").astype(bool)
        self.per_record = np.asarray(batch.column("sizes").value_lengths().fill_null(0))
        self.record = np.repeat(np.arange(len(self.per_record)), self.per_record)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(int) if len(self.sizes) else np.zeros(0, dtype=int)
        self.marks = self.buckets[self.starts] // GROUP_SIZE == MARKS if len(self.sizes) else np.zeros(0, dtype=bool)

    def beside(self, p: np.ndarray) -> np.ndarray:
        """How sure it is that another passage of the record is positive."""
        return np.clip(np.bincount(self.record, weights=p, minlength=len(self.per_record))[self.record] - p, 0, 1)

    def start(self) -> np.ndarray:
        return np.where(self.sure, 1.0, np.where(self.marks, 0.5, 0.0))

    def odds(self, model: Model, p: np.ndarray) -> np.ndarray:
        """Log-odds of each passage, ``p`` being what was known of its neighbours."""
        beside, kind = self.beside(p), self.marks.astype(int)
        prior = beside * model.priors[kind, 1] + (1 - beside) * model.priors[kind, 0]
        return np.add.reduceat(model.weights[self.buckets], self.starts) + np.log(prior) - np.log1p(-prior)

    def walk(self, models: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds and probabilities under the last model, and what counts beside a passage: at the start only what is trusted.

        A passage's neighbours are judged by the models before.
        """
        p, known, odds = self.start(), self.sure.astype(float), np.zeros(len(self.sizes))
        for model in models:
            odds = self.odds(model, known)
            p = known = np.where(self.sure, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))
        return odds, p, self.beside(known)


class Model:
    def __init__(self, weights: np.ndarray, priors: np.ndarray) -> None:
        self.weights, self.priors = weights, priors


#: Rows of a round that aren't buckets: expected cases without and with a case beside, and all passages likewise, of sentences and of marks.
EXTRA = 8


def _count(encoded: DataFrame, models: list[Model], with_all: bool) -> pd.DataFrame:
    """One round: ``bucket, positive, taken, n_all`` summed over all passages.

    ``positive`` is what counts for the cases, ``taken`` what no longer counts for the others; ``n_all`` is counted in the first round only.

    A task covers several partitions, so the rows to add up grow with the cores, not with the data.
    """
    context = encoded.sparkSession.sparkContext
    shared = context.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        positive, taken, n_all, found = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS if with_all else 1), np.zeros(EXTRA)
        for batch in batches:
            here = Passages(batch)
            if not len(here.sizes):
                continue
            _, p, beside = here.walk(known)
            for kind, own in enumerate((~here.marks, here.marks)):
                for with_case, share in enumerate((1 - beside[own], beside[own])):
                    found[kind * 4 + with_case] += (share * p[own]).sum()
                    found[kind * 4 + 2 + with_case] += share.sum()
            counted = np.where(here.sure, p, np.where(here.marks, FOUND_MARKS, FOUND) * p)
            some = np.repeat(p > 1e-9, here.sizes)
            positive += np.bincount(here.buckets[some], weights=np.repeat(counted, here.sizes)[some], minlength=BUCKETS)
            taken += np.bincount(here.buckets[some], weights=np.repeat(p, here.sizes)[some], minlength=BUCKETS)
            if with_all:
                n_all += np.bincount(here.buckets, minlength=BUCKETS)
        used = np.flatnonzero((positive > 0) | (n_all > 0) if with_all else positive > 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((used, -1 - np.arange(EXTRA, dtype=np.int32)))),
                pa.array(np.concatenate((positive[used], found))),
                pa.array(np.concatenate((taken[used], np.zeros(EXTRA)))),
                pa.array(np.concatenate((n_all[used] if with_all else np.zeros(len(used)), np.zeros(EXTRA)))),
            ],
            ["bucket", "positive", "taken", "n_all"],
        )

    tasks = min(encoded.rdd.getNumPartitions(), 4 * context.defaultParallelism)
    rows = (
        encoded.select("buckets", "sizes", "sure").coalesce(max(1, tasks))
        .mapInArrow(run, "bucket int, positive double, taken double, n_all double")
        .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("positive", "taken", "n_all")))
        .toPandas()  # at most BUCKETS + EXTRA rows
    )
    shared.destroy()
    return rows


def _model(positive: np.ndarray, taken: np.ndarray, n_all: np.ndarray, found: np.ndarray) -> Model:
    """Log ratios of the two classes within each group, and the priors."""
    weights = np.zeros(BUCKETS, dtype=np.float32)
    for group in range(1 << GROUP_BITS):
        own = slice(group * GROUP_SIZE, (group + 1) * GROUP_SIZE)
        seen = n_all[own] > 0
        if not seen.any():
            continue
        everything, cases = n_all[own][seen], positive[own][seen]
        others, base = np.maximum(everything - taken[own][seen], 0), everything / everything.sum()
        share = lambda c: (1 - COMMON) * c / max(c.sum(), 1e-9) + COMMON * base  # noqa: B023, E731
        weights[own][seen] = np.log(share(cases)) - np.log(share(others)) if cases.sum() > 0 else -50.0
    f = found.reshape(2, 2, 2)  # kind, cases or all, without or with a case beside
    return Model(weights, (f[:, 0] + 1) / (f[:, 1] + 2))


def fit(encoded: DataFrame) -> list[Model]:
    """The last two models: the second judges a passage, the first its neighbours."""
    models: list[Model] = []
    n_all, before = np.zeros(BUCKETS), -1.0
    for _ in range(MOST_ROUNDS):
        rows = _count(encoded, models, with_all=not models)
        positive, taken = np.zeros(BUCKETS), np.zeros(BUCKETS)
        kept, extra = rows[rows.bucket >= 0], rows[rows.bucket < 0]
        positive[kept.bucket], taken[kept.bucket] = kept.positive, kept.taken
        if not models:
            n_all[kept.bucket] = kept.n_all
        found = np.zeros(EXTRA)
        found[-1 - extra.bucket] = extra.positive
        models = [*models[-1:], _model(positive, taken, n_all, found)]
        cases = found[[0, 1, 4, 5]].sum()
        if before >= 0 and abs(cases - before) <= STEADY * max(cases, 1.0):
            return models
        before = cases
    raise RuntimeError(f"the expected cases didn't become steady in {MOST_ROUNDS} rounds")


def find_residue(df: DataFrame, key: str, text: str, trust: Trust = trusted) -> DataFrame:
    """``key, score`` of the documents with a passage that is residue; the score is the highest log-odds."""
    encoded = encode(df, key, text, trust)
    shared = df.sparkSession.sparkContext.broadcast(fit(encoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            here = Passages(batch)
            with_some = np.flatnonzero(here.per_record)
            if not len(with_some):
                continue
            odds, _, _ = here.walk(models)
            best = np.maximum.reduceat(odds, np.concatenate(([0], np.cumsum(here.per_record[with_some])[:-1])).astype(int))
            cases = best > LEAST_ODDS
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(with_some[cases])), pa.array(best[cases].astype(float))], ["key", "score"])

    return encoded.mapInArrow(run, f"key {dict(df.dtypes)[key]}, score double").withColumnRenamed("key", key)
