"""Sentence units of texts in English, Japanese, Hindi and Bengali.

Method: spaced scripts go through a lattice of terminators. Every mark that may end a sentence is a
node; what stands before it (abbreviation, initial, number, pause) and what opens after it decides
whether the path breaks there. A run of spaceless script is cut into words by the cheapest path through a
lattice of dictionary words, and its gaps are classified by the word that closes it (a final form or
particle, or one that asks for more) and the word that opens after it: at a pause the closing word decides,
and without any mark a sentence ends where a final form meets an opening word. Marks within quotations and
brackets never break; a quotation joins the words that report it.

The segmenter is a plain function of one text, so the work is one Arrow-batched pass over the rows
without a shuffle. Null and blank texts give no rows, repeated rows give repeated rows, an empty table
gives an empty result, texts of any length are read whole in linear time, further columns of the input
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations that take a point and go on with a name or a number.
TITLES = frozenset(
    "dr mr mrs ms mme st mt ft rev hon prof capt col gen lt sgt maj sr jr pt pvt vol vols ch chap no nos pp p fig figs sec art ed eds "
    "cf vs approx ca viz dept est fr messrs eg ie "
    "डॉ डा पं श्री श्रीमती सुश्री कु प्रो पृ सं खं क्र रु मो मि स्व ले उदा "
    "ডা ড ডঃ ডক্টর মো মোঃ পৃ সং খ শ্রী শ্রীমতী প্রো মি মিসেস রু নং সে অধ্যা ইঞ্জি বি দ্র".split()
)
# Abbreviations that end a sentence only where a new sentence opens after them.
OPEN_ABBREVIATIONS = frozenset("a.m p.m am pm etc co ltd inc bros i.e e.g b.c a.d ibid al u.s jan feb mar apr jun jul aug sep sept oct nov dec इत्यादि आदि ইত্যাদি".split())
# Marks.
ENDS = ".!?。！？．।॥৷｡؟"
PAUSES = "…‥"
OPENERS, CLOSERS = "“‘「『（(［[【〈《｛{«", "”’」』）)］]】〉》｝}»"
QUOTE_CLOSERS = "”」』»\""
PAIR = dict(zip(CLOSERS, OPENERS, strict=True))
SEPARATOR = re.compile(r"[\s\W_ーｰ]*")
# Verbs that report a quotation.
SAYING = (
    "said|says|asked|asks|cried|cries|replied|answered|whispered|shouted|called|told|muttered|murmured|exclaimed|added|begged|warned|ordered|declared|"
    "sighed|yelled|screamed|remarked|wondered|insisted|continued|laughed|demanded|announced|repeated|promised|pleaded"
)
SAYING_HI = "कहा|पूछा|बोला|बोली|बोले|चिल्लाया|चिल्लाई|पुकारा|उत्तर|जवाब|फुसफुसाया|फुसफुसाई|समझाया|बताया|सोचा|कहने|पूछने"
SAYING_BN = "বলল|বলেন|বললেন|বললো|জিজ্ঞাসা|জিজ্ঞেস|চিৎকার|চেঁচিয়ে|উত্তর|জবাব|ফিসফিস|ডাকল|ডাকলেন|জানালেন|জানাল|ভাবল|শুধাল|শুধালেন"
SAYING_JA = "言っ|言い|叫ん|叫び|尋ね|訊い|聞い|答え|ささや|囁|つぶや|呟|告げ|述べ|怒鳴|どな|呼ん|うめ|応じ|問う|問い|話し|続け"
NAME = r"(?:[A-ZÀ-ÖØ-ÞĀ-Ž][\w'’̀-ͯ.\-]*|II+|IV|\(\d+\)|of|de)"
REPORT_EN = re.compile(rf"\s*(?:(?:[Tt]he|[Aa]n?|[Hh]is|[Hh]er|[Hh]e|[Ss]he|[Tt]hey|[Ii]t|I|[Ww]e|[Ee]veryone|[Ss]omeone)\s+)?(?:{NAME}\s+|[a-z]+\s+){{0,4}}?(?:{SAYING})\b")
REPORT_EN_STRICT = re.compile(rf"\s*(?:(?:[Hh]e|[Ss]he|[Tt]hey|I|[Ww]e|[Ee]veryone|[Ss]omeone)\s+|(?:[Tt]he|[Aa]|[Aa]n|[Hh]is|[Hh]er)\s+[a-z]+(?:\s+[a-z]+)?\s+|(?:{NAME}\s+){{1,4}})?(?:then\s+|softly\s+)?(?:{SAYING})\b")
REPORT_HI = re.compile(rf"\s*(?:[ऀ-ॣ॰-ॿ\w().\-]+\s+){{0,5}}?ने\s+(?:[ऀ-ॣ]+\s+){{0,4}}?(?:{SAYING_HI})|\s*(?:[ऀ-ॣ()\w\-]+\s+){{0,3}}?(?:बोला|बोली|बोले|चिल्लाया|चिल्लाई)")
REPORT_BN = re.compile(rf"\s*(?:[ঀ-৾()\w.\-]+\s+){{1,4}}?(?:{SAYING_BN})")
REPORT_JA = re.compile(rf"[^。！？「」『』\n]{{0,40}}?(?:そう|こう)[^。！？「」『』\n]{{0,12}}?(?:{SAYING_JA})")
QUOTING_JA = re.compile(r"(?:と|って|という|とか|など|、と|のだ|を|が|は|に|の|も|で|へ|から|まで)")
TOGETHER_JA = re.compile(r"と(?:二人|ふたり|三人|四人|両人|皆|みな|みんな|人々|彼ら|彼女ら|一同|口々|群衆|兵たち|[^。「」]{1,12}?たち|[^。「」]{1,12}?と[^。「」]{1,12}?は)")
TOGETHER_EN = re.compile(r"\s*(?:(?:the two|both|they|the twins|all|everyone|the others)\b|(?:[A-Z]\S*\s+){1,3}and\s)", re.I)
# Words that carry a sentence on after a pause.
CARRYING = frozenset(
    "फिर और पर लेकिन मगर तब तो कि किंतु परन्तु परंतु क्योंकि या तारपर ताकि बल्कि जैसे "
    "তারপর আর কিন্তু তবে এবং তখন তবু অথবা বা যে যেন কারণ ফের আবার পরে শেষে".split()
)

# The dictionary of the word lattice. Costs are lower for longer and surer words.
# kind: f closes a sentence (final forms and particles), c asks for more (case and linking particles), o opens one.
LATTICE_WORDS = {
    **dict.fromkeys("た だ です ます ました でした ません ない なかった だった である であった だろう でしょう いた った んだ いだ えた けた せた れた げた てた めた べた ねた きた した いる ある する れる られる せる う く る い".split(), ("f", 2.0)),
    **dict.fromkeys("か ね よ な ぞ ぜ さ わ かな かしら のか ものか ください なさい".split(), ("f", 1.8)),
    **dict.fromkeys("は が を に へ で と の も や から まで より ので のに けれど けど ながら たり ては ても なら ば し て で、 には では とは への との からは までに について として そして しかし だが 、 ，".split(), ("c", 1.8)),
    **dict.fromkeys("そして しかし だが また すると それで そこで やがて ところが けれども なぜなら".split(), ("o", 1.5)),
}
LONGEST = max(map(len, LATTICE_WORDS))
# Final forms that end a sentence before an opening word even where no mark stands between them.
SURELY_FINAL = frozenset("です ます ました でした ません だった であった だろう でしょう いた った んだ いだ えた けた せた れた げた てた めた べた ねた きた した た だ".split())


def script(ch: str) -> str:
    if "぀" <= ch <= "ゟ":
        return "h"
    if "゠" <= ch <= "ヿ" or ch == "ｰ":
        return "k"
    if "一" <= ch <= "鿿" or ch in "々〆":
        return "j"
    return "d" if ch.isdigit() else "l" if ch.isalpha() else "p"


def lattice(text: str) -> list[tuple[str, str]]:
    """The cheapest path of dictionary words and runs of one script: ``[(word, kind)]``."""
    n = len(text)
    cost, back = [0.0] + [1e9] * n, [(0, "")] * (n + 1)
    for i in range(n):
        if cost[i] >= 1e9:
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if (known := LATTICE_WORDS.get(text[i:j])) and (c := cost[i] + known[1]) < cost[j]:
                cost[j], back[j] = c, (i, known[0])
        kind, j = script(text[i]), i + 1
        while j <= n:
            price = {"h": 2.6 * (j - i), "k": 3.0, "j": 2.5 + 0.5 * (j - i), "d": 3.0, "l": 3.0}.get(kind, 3.0)
            if (c := cost[i] + price) < cost[j]:
                cost[j], back[j] = c, (i, "x")
            if j == n or script(text[j]) != kind or kind == "p":
                break
            j += 1
    path, j = [], n
    while j:
        i, kind = back[j]
        path.append((text[i:j], kind))
        j = i
    return path[::-1]


def closes(before: str) -> bool:
    """Whether the words before a pause in spaceless script can end a sentence."""
    path = lattice(before)
    return bool(path) and path[-1][1] == "f"


RUN = re.compile("[぀-ヿ一-鿿々〆ｰ、，]+")


class Gaps:
    """The gaps between words of a line's spaceless runs; each run is cut into words once, when it is first asked for."""

    def __init__(self, line: str) -> None:
        self.line, self.runs = line, [m.span() for m in RUN.finditer(line)]
        self.kinds: dict[int, str] = {}  # of the word that ends before a place
        self.read = 0

    def _to(self, place: int) -> None:
        while self.read < len(self.runs) and self.runs[self.read][0] < place:
            at, end = self.runs[self.read]
            for word, kind in lattice(self.line[at:end]):
                at += len(word)
                self.kinds[at] = kind
            self.read += 1

    def closes(self, place: int) -> bool:
        """Whether the word that ends at ``place`` can end a sentence."""
        self._to(place)
        return self.kinds.get(place) == "f"

    def unmarked(self, start: int, end: int) -> Iterator[int]:
        """Places within a run where a final form meets an opening word."""
        for m in OPENING.finditer(self.line, start, end):
            self._to(m.end())
            at = m.start()
            if self.kinds.get(m.end()) == "o" and self.kinds.get(at) == "f" and any(self.line.endswith(w, start, at) for w in SURELY_FINAL):
                yield at


OPENING = re.compile("|".join(sorted((w for w, (kind, _) in LATTICE_WORDS.items() if kind == "o"), key=len, reverse=True)))


def spaceless(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "一" <= ch <= "鿿"


TOKEN = re.compile("[" + re.escape(ENDS + PAUSES + OPENERS + CLOSERS) + "\"]")
# What may stand before the first word of a line: blank space, a bullet, a number.
LEAD = re.compile(r"[\s　]*(?:[-*•・]\s+)?(?:[(（\[]?[\d०-९০-৯０-９]{1,4}[.)）\]．:：、]?[\s　]*)?")
BLANK = re.compile(r"\s*")
NUMBER = re.compile(r"[(（\[]?[\d०-९০-৯０-９]{1,4}")
NO_WORD = frozenset(OPENERS + CLOSERS + "\"。！？।,、")


def _straight_quotes(line: str) -> set[int]:
    """Positions of straight quotation marks that open."""
    places = [m.start() for m in re.finditer('"', line)]
    return {p for k, p in enumerate(places) if k % 2 == 0}


def _next(line: str, j: int) -> int:
    """The place of the next character that isn't blank."""
    return BLANK.match(line, j).end()


def _first(line: str, start: int) -> int:
    """The place of the first character of a unit, ideographic spaces being blank, too."""
    while start < len(line) and line[start] in " 　":
        start += 1
    return start


def _breaks_point(line: str, start: int, i: int, j: int) -> bool:
    """Whether the point at ``i`` ends a sentence; ``j`` is the place after all marks that follow it."""
    n, last, after = _next(line, j), line[i - 1] if i > start else "", line[j : j + 1]
    if n == len(line):
        return True
    if line[i] == "．" and spaceless(line[n]) and not last.isdigit():
        return True
    if last.isdigit() and after.isdigit():
        return False
    first = _first(line, start)
    if first >= i or i - first <= 6 and NUMBER.fullmatch(line[first:i].rstrip(" 　")):
        return False  # a number that opens the line
    w = i
    while w > start and not line[w - 1].isspace() and line[w - 1] not in NO_WORD:
        w -= 1
    word = line[w:i]
    bare = word.strip("“‘「『（(").lower()
    spaced = after.isspace()
    if bare in TITLES:
        return False
    initial = "A" <= last <= "Z" or "À" <= last <= "Ž"
    if re.fullmatch(r"(?:[A-Za-zÀ-ž]\.)+[A-Za-zÀ-ž]|[A-ZÀ-Ž]", word) or initial and (i - 1 == start or not re.match(r"\w", line[i - 2])):
        if bare in OPEN_ABBREVIATIONS:
            return spaced and (line[n].isupper() or line[n] in OPENERS + '"')
        return False  # initials
    if not spaced and after.islower() and after.isascii():
        return False
    if bare.rstrip(".") in OPEN_ABBREVIATIONS:
        return line[n].isupper() or line[n] in OPENERS + '"' or not line[n].isascii() and not line[n].isdigit()
    if line[n].islower() and line[n].isascii():
        return False
    if not spaced and after.isdigit():
        return not last.isdigit()
    return True


FIRST_WORD = re.compile(r"[^\s।,!?.]+")


def _opens_more(line: str, start: int, i: int, j: int, gaps: Gaps) -> bool:
    """Whether the sentence goes on behind a pause that ends before ``j``."""
    n = _next(line, j)
    if n == len(line):
        return False
    last = i
    while last > start and line[last - 1].isspace():
        last -= 1
    if last == start:
        return True
    if spaceless(line[last - 1]) or spaceless(line[n]):
        return not gaps.closes(last) or line[n] in "、，と"
    if line[n].islower() or line[n] in ",;":
        return True
    first = FIRST_WORD.match(line, n)
    return bool(first and first[0] in CARRYING)


def _reported(line: str, j: int) -> bool:
    """Whether what follows a closed quotation reports it."""
    n = _next(line, j)
    if n == len(line):
        return False
    head = line[n]
    if spaceless(head):
        return bool(QUOTING_JA.match(line, n) and not line.startswith(("という間", "その", "この"), n)) or bool(REPORT_JA.match(line, n))
    if "ऀ" <= head <= "ॿ":
        return bool(REPORT_HI.match(_clause(line, n)))
    if "ঀ" <= head <= "৿":
        return bool(REPORT_BN.match(_clause(line, n)))
    if head in ",;:—–-" or head.islower():
        return True
    return bool(REPORT_EN_STRICT.match(line, n))


CLAUSE = re.compile(r"[^।.!?৷\n“‘\"]*")
QUOTED_ON = re.compile("と(?!ころ)")


def _clause(line: str, j: int) -> str:
    return CLAUSE.match(line, j)[0]


def _spans(line: str) -> Iterator[tuple[int, int]]:
    """Start and end of each unit of one line: the gaps that marks make, and those of spaceless script without a mark."""
    gaps = Gaps(line)
    for start, end in _marked_spans(line, gaps):
        for at in gaps.unmarked(start, end) if spaceless_within(line, start, end) else ():
            yield start, at
            start = at
        yield start, end


def spaceless_within(line: str, start: int, end: int) -> bool:
    """Whether a unit is in spaceless script and without a quotation, whose words say nothing about the unit's own gaps."""
    m = RUN.search(line, start, end)
    return bool(m) and not QUOTE_MARK.search(line, start, end)


QUOTE_MARK = re.compile("[" + re.escape(OPENERS + CLOSERS) + "\"]")


def _marked_spans(line: str, gaps: Gaps) -> Iterator[tuple[int, int]]:
    n, start, stack, i = len(line), 0, [], 0
    opens = _straight_quotes(line)
    while True:
        m = TOKEN.search(line, i)
        if not m:
            break
        i, ch = m.start(), m[0]
        if ch == "’" and (not stack or stack[-1][0] != "‘"):  # an apostrophe
            i += 1
            continue
        if ch in OPENERS or ch == '"' and i in opens:
            stack.append((ch, i))
            i += 1
            continue
        if ch in CLOSERS or ch == '"':
            want, opener = PAIR.get(ch, '"'), -1
            if any(x[0] == want for x in stack):
                while stack:
                    kind, place = stack.pop()
                    if kind == want:
                        opener = place
                        break
            i += 1
            if stack:
                continue
            if opener < start:
                opener = -1
            inner = line[i - 2 : i - 1]
            bracket = ch not in QUOTE_CLOSERS and ch != "’"
            if inner and (inner in ENDS or inner in PAUSES) and not bracket or bracket and inner in ENDS and LEAD.fullmatch(line, start, max(start, opener)):
                j = i
                while j < n and line[j] in ENDS + PAUSES:
                    j += 1
                k = _next(line, j)
                alone = bool(opener >= 0 and LEAD.fullmatch(line, start, opener))
                if j > i:
                    yield start, j
                    start = i = j
                elif k == n:
                    continue
                elif bracket:
                    if not (line[k].islower() or line[k] in ",;、，"):
                        yield start, j
                        start = i = j
                elif line[k] in "「『“\"" and alone:
                    # adjoining quotations: together only where one report follows for both
                    close = _close_of(line, k)
                    after = _next(line, close) if close else n
                    together = after < n and (TOGETHER_JA.match(line, after) if spaceless(line[after]) else TOGETHER_EN.match(line, after) and REPORT_EN.match(line, after))
                    if not together:
                        yield start, j
                        start = i = j
                elif alone:
                    if not _reported(line, j):
                        yield start, j
                        start = i = j
                elif not (line[k] in ",、，" or line[k].islower() or spaceless(line[k]) and QUOTING_JA.match(line, k)):
                    yield start, j
                    start = i = j
            continue
        # a terminator or a pause
        j = i + 1
        while j < n and line[j] in ENDS + PAUSES:
            j += 1
        run = line[i:j]
        if stack:
            i = j
            continue
        k = j
        while k < n and line[k] in CLOSERS and line[k] != "’":
            k += 1
        pause = run[0] in PAUSES or run.startswith("..") and not re.search("[!?！？。।]", run)
        if pause and not re.search("[!?！？。।]", run):
            ends = not _opens_more(line, start, i, j, gaps)
        elif run in (".", "．"):
            ends = _breaks_point(line, start, i, k)
        elif run[0] in ".．" and len(run) > 1:
            ends = True
        else:
            x = _next(line, k)
            ends = not (x < n and (line[x].islower() and line[x].isascii() or line[x] in ",、，")) and not (x < n and spaceless(line[x]) and run[-1] in "!?！？" and QUOTED_ON.match(line, x))
        i = k
        if ends:
            yield start, k
            start = k
    if start < n and _next(line, start) < n:
        yield start, n


def _close_of(line: str, opener: int) -> int:
    want = {v: k for k, v in PAIR.items()}.get(line[opener], '"')
    end = line.find(want, opener + 1)
    return end + 1 if end >= 0 else 0


BREAKS = re.compile("[\n\r\u0085  ]+")
BLANKS = " \t\n\r\x0b\x0c\u0085             ​    　﻿"


def units(text: str | None) -> list[tuple[int, int]]:
    """``[(start, length)]`` of the sentence units, start counted from 1."""
    if not text:
        return []
    out, at = [], 0
    for line in [*BREAKS.split(text)]:
        at = text.find(line, at) if line else at
        whole = line.strip(BLANKS)
        if whole and not (SEPARATOR.fullmatch(whole) and not re.search(r"[!?.。！？।…]", whole)):
            # a heading, verse or note without inner ends comes out whole
            spans = [(0, len(line))] if re.match(r"\s*#{1,6}\s", line) or re.fullmatch(r"\s*[\[【].*[\]】]\s*", line) and line.count("[") + line.count("【") == 1 else _spans(line)
            for a, b in spans:
                piece = line[a:b]
                if inner := piece.strip(BLANKS):
                    first = a + piece.index(inner[0], len(piece) - len(piece.lstrip(BLANKS)))
                    if re.search(r"\w", inner) or not out or SEPARATOR.fullmatch(inner) is None or re.search(r"[!?.。！？।…]", inner):
                        out.append((at + first + 1, len(inner)))
        at += len(line)
    return out


UNIT = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("n_chars", T.IntegerType())]))


def units_column(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start_pos": a, "n_chars": n} for a, n in units(t)])

    return F.pandas_udf(of, UNIT)(text)


def sentence_units(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, start_pos, n_chars``: a row for each unit of ``text``."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.inline(units_column(F.col(text))))
