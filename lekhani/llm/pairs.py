"""Prompt and response pairs that can't be used as pairs, with the kind of their defect.

Method: the words of prompt and response are aligned. A response is a copy where the shingles of the
prompt lie in it and the longest common subsequence covers prompt and response but for a framing; it is
a refusal where its words align with a refusal template. Empty values, cut ends and other languages are
told from the response's own characters, words and marks, with counts of words over the whole table.

Responses that are looked up among the marked ones are shuffled with their prompts, all others stay on their row. Null and blank responses are empty, a null prompt can't be copied, repeated rows
count each, an empty table gives an empty result, a response that fits several kinds takes the first of
empty, copied, refusal, other_language, truncated; texts of any length are read whole; further columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, least containment of the prompt's shingles, least share of the prompt and of the response in the common subsequence.
SHINGLE, CONTAINED, OF_PROMPT, OF_RESPONSE = 3, 0.8, 0.85, 0.6
#: Least share of letters in the language's own script.
OWN_SCRIPT = 0.5

# Words and marks that stand for nothing.
NOTHING = frozenset("none null nil nan n/a na undefined empty blank - -- --- — – ― … ... .. . , ? ? ! 。 、 । ॥ ・ * _ [] {} () (none) [none] (empty) \"\" '' “” ‘’ 「」 なし 無し ない 無 該当なし 空 空欄 कोई नहीं कुछ नहीं रिक्त शून्य নেই কিছু না কিছুই না শূন্য ফাঁকা tbd todo".split()) | {"कोई नहीं", "कुछ नहीं", "কিছু নেই", "no answer", "কিছু না"}

# Refusal templates by language; * stands for some words, a|b for one of several.
REFUSALS = {
    "en": [
        "i|we|i'm|we're cannot|can't|couldn't|won't|unable|mustn't|decline|declined * answer|help|discuss|say|tell|comply|respond|provide|share|assist|comment|determine|speculate",
        "that|this|it|which is|lies|falls|goes beyond|outside * i|we|my|our can|may|am|are|scope|remit|task",
        "the|this text|passage|passages|chapter|chapters|context|material|excerpt|document|source doesn't|don't|never|not|no|nothing * say|says|mention|mentions|mentioned|state|states|stated|contain|contains|tell|tells|answer|specify|information",
        "nobody|nothing|nowhere|no * in the text|passage|passages|chapter|chapters|context|material|excerpt says|say|mentions|states|tells|answers|explains",
        "there is|isn't|are|aren't no|not|nothing|enough|insufficient * information|mention|answer|detail|context|text|passage",
        "i cannot help with *", "i can't help with *", "i can't answer that", "i cannot answer *", "i'm sorry but i can't *", "i am sorry but i cannot *", "i'm sorry i can't *",
        "i am unable to *", "i'm unable to *", "as a language model *", "as an ai *", "i'd rather not *", "i would rather not *", "i won't *", "i will not answer *", "i must decline *",
        "it is not possible for me to *", "it's not possible to determine *", "it is not possible to determine *", "the passage gives no information *", "the text gives no information *",
        "the provided text does not *", "the provided context does not *", "the passage does not *", "the context does not *", "the material does not *", "no information is *", "no answer can be given *",
        "there is no information *", "there is not enough information *", "i was not given enough *", "i do not have enough *", "i don't have enough *", "i do not have access *", "i don't have access *", "i do not know *", "i don't know *",
        "sorry this question falls outside what i may *", "this question falls outside *", "i apologize *", "sorry i *", "unfortunately i *", "not enough information *", "the answer is not available *", "the answer is not in *",
        "this cannot be determined *", "the chapters do not *", "the supplied chapters do not *", "not mentioned in the *", "i cannot find *", "i could not find *", "i can't find *", "i cannot determine *", "in the passage there is no information *",
    ],
    "ja": [
        "申し訳ありませんが * できません", "申し訳ございませんが * できません", "申し訳ありません * できません", "すみませんが * できません", "* お答えできません", "* お答えすることはできません", "* 判断できません", "* お手伝いできません",
        "ai として * できません", "言語モデル * できません", "* の情報が与えられていません", "* 情報が与えられていません", "* 情報がありません", "* 情報はありません", "* 情報が含まれていません", "* 記載がありません", "* 記載されていません", "* 書かれていません",
        "* 回答できません", "* 分かりません", "* わかりません", "* 特定できません", "* 見つかりません", "* お答えしかねます", "* 回答を控え *", "* 言及されていません", "* 応じられません",
    ],
    "hi": [
        "मैं|हम * उत्तर|जवाब|मदद|सहायता * नहीं|असमर्थ",
        "पाठ|अंश|अध्याय|सामग्री|संदर्भ में * उल्लेख|जानकारी|उत्तर|जवाब * नहीं",
        "क्षमा करें मैं * नहीं *", "माफ़ करें मैं * नहीं *", "माफ कीजिए * नहीं *", "* मैं * उत्तर नहीं दे सकता", "* मैं * उत्तर नहीं दे सकती", "मैं * असमर्थ हूँ", "* मैं * असमर्थ हूँ", "दिए गए पाठ में * नहीं है", "* पाठ में * जानकारी नहीं है",
        "* कोई जानकारी नहीं है", "* कोई जानकारी नहीं दी गई *", "* उल्लेख नहीं है", "मुझे नहीं पता *", "मुझे * जानकारी नहीं *", "एक भाषा मॉडल * नहीं *", "एक एआई * नहीं *", "* मदद नहीं कर सकता", "* सहायता नहीं कर सकता", "* बताना संभव नहीं *", "* बताया नहीं जा सकता",
    ],
    "bn": [
        "আমি|আমরা * উত্তর|জবাব|সাহায্য * না|পারছি|পারব|অক্ষম|অপারগ",
        "পাঠে|পাঠ্যে|অংশে|অধ্যায়ে|প্রসঙ্গে * উল্লেখ|তথ্য|উত্তর * নেই|হয়নি",
        "দুঃখিত আমি * না", "দুঃখিত * পারছি না", "দুঃখিত * পারব না", "আমি * উত্তর দিতে পারছি না", "আমি * উত্তর দিতে পারব না", "* আমি * অক্ষম", "আমি * অক্ষম", "প্রদত্ত অংশে * নেই", "প্রদত্ত পাঠে * নেই", "* কোনো তথ্য নেই", "* তথ্য দেওয়া হয়নি", "* উল্লেখ নেই",
        "আমি জানি না *", "আমার জানা নেই *", "একটি ভাষা মডেল * না", "* সাহায্য করতে পারছি না", "* বলা সম্ভব নয়", "* বলা সম্ভব না", "* নির্ধারণ করা সম্ভব *",
    ],
}

WORD = re.compile(r"[a-zà-ɏ̀-ͯ]+(?:['’][a-z]+)?|[ऀ-ॣ॰-ॿ]+|[ঀ-৥ৰ-৾]+|[゠-ヿ]+|[぀-ゟ一-鿿]|\d+")
QUOTED = re.compile(r"“[^”]*”|「[^」]*」|『[^』]*』|\"[^\"]*\"|«[^»]*»")
SENTENCE = re.compile(r"(?<=[.!?。！？।৷])\s*")
# Framings of a repeated prompt are at most so many words longer than it; words that may follow it and say nothing.
FRAMING = 6
AFTER = frozenset("you ask asked is was the this that my your question right please ok i see です か と の है হয় यह আপনি आप प्रश्न প্রশ্ন".split())


def words(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'"))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        matched = row & places.get(w, 0)
        row = (row + matched | row - matched) & full
    return len(a) - row.bit_count()


def containment(a: list[str], b: list[str]) -> float:
    """Share of the shingles of ``a`` that lie in ``b``."""
    k = min(SHINGLE, len(a))
    own = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
    there = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    return len(own & there) / len(own) if own else 0.0


def copied(prompt: list[str], response: list[str]) -> bool:
    """Whether the response gives the prompt back, once or several times, and no more than a framing."""
    if len(prompt) < 3 or containment(prompt, response) < CONTAINED:
        return False
    last = max((i for i, w in enumerate(response) if w == prompt[-1]), default=len(response) - 1)
    if any(w not in AFTER for w in response[last + 1 :]):
        return False  # an answer follows
    times = max(1, round(len(response) / len(prompt)))
    rest = len(response) - common_length(prompt * times, response)
    return common_length(prompt, response) >= OF_PROMPT * len(prompt) and rest <= min(FRAMING, (1 - OF_RESPONSE) * len(response) + 2)


#: Words that may stand between two neighbouring words of a template, and in place of a *; least share of a template's words that align.
SKIP, GAP, ALIGNED = 1, 8, 0.85


class Template:
    """A refusal as words in order, some of them one of several, with the room that may lie before each."""

    def __init__(self, text: str) -> None:
        self.slots: list[frozenset[str]] = []
        self.room: list[int] = []
        wide = False
        for part in text.split():
            if part == "*":
                wide = True
                continue
            options = [words(o) for o in part.split("|")]
            if len(options) > 1:
                self._add(frozenset(w for o in options for w in o), wide)
            else:
                for k, w in enumerate(options[0]):
                    self._add(frozenset([w]), wide and k == 0)
            wide = False
        self.least = max(1, math.ceil(ALIGNED * len(self.slots)))

    def _add(self, slot: frozenset[str], wide: bool) -> None:
        self.slots.append(slot)
        self.room.append(GAP if wide else SKIP)

    def aligns(self, own: list[str]) -> bool:
        """Whether the longest common subsequence of template and sentence, with no more between two words than there is room, has enough of the template."""
        # best[i]: (words aligned, place of the last) of alignments that end at slot i, one for each place
        ends: list[list[tuple[int, int]]] = []
        for i, slot in enumerate(self.slots):
            here = []
            for place, w in enumerate(own):
                if w not in slot:
                    continue
                most, room = 1, 0
                for k in range(i - 1, -1, -1):
                    room += self.room[k + 1]
                    most = max([most, *(n + 1 for n, at in ends[k] if at < place and place - at - 1 <= room)])
                here.append((most, place))
            ends.append(here)
        return any(n >= self.least for here in ends for n, _ in here)


TEMPLATES = [Template(t) for ts in REFUSALS.values() for t in ts]
BY_WORD: dict[str, list[tuple[int, int]]] = {}
for _k, _t in enumerate(TEMPLATES):
    for _i, _slot in enumerate(_t.slots):
        for _w in _slot:
            BY_WORD.setdefault(_w, []).append((_k, _i))


def refuses(text: str) -> bool:
    """Whether a sentence, without what it quotes, aligns with a refusal template of any language."""
    for sentence in SENTENCE.split(QUOTED.sub(" “” ", text)):
        own = words(sentence)
        held: dict[int, set[int]] = {}
        for w in set(own):
            for k, i in BY_WORD.get(w, ()):
                held.setdefault(k, set()).add(i)
        if any(len(slots) >= TEMPLATES[k].least and TEMPLATES[k].aligns(own) for k, slots in held.items()):
            return True
    return False


def means_nothing(text: str | None) -> bool:
    if text is None:
        return True
    shown = re.sub(r"[­͏​-‏⁠-⁤﻿]", "", text)
    bare = shown.strip(" \t\n\r\x0b\x0c              　").lower()
    core = bare.strip("\"'“”‘’「」『』()（）[]{}<>.。।!?*_ ")
    return not bare or bare in NOTHING or core in NOTHING or not re.search(r"[^\W_]", core)


SCRIPTS = {"ja": re.compile(r"[぀-ヿ一-鿿々]"), "hi": re.compile(r"[ऀ-ॣ॰-ॿ]"), "bn": re.compile(r"[ঀ-৥ৰ-৾]"), "en": re.compile(r"[A-Za-zÀ-ɏ]")}
BRACKETED = re.compile(r"\([^)]*\)|（[^）]*）|\[[^\]]*\]")


def script_share(text: str, lang: str) -> float | None:
    """Share of the letters that belong to the language's script; null without letters."""
    plain = BRACKETED.sub(" ", text)
    counts = {k: len(v.findall(plain)) for k, v in SCRIPTS.items()}
    return counts[lang] / sum(counts.values()) if lang in counts and sum(counts.values()) else None


def latin_words(text: str) -> list[str]:
    """Words in Latin script that aren't written like names, and a function word at the beginning."""
    plain = BRACKETED.sub(" ", text)
    found = re.findall(r"[A-Za-zÀ-ɏḀ-ỿ̀-ͯ]+(?:['’][A-Za-z]+)?", plain)
    first = [w for w in map(str.lower, found[:1]) if len(found) > 1 and found[0][0].isupper() and (w in ENGLISH or w in FOREIGN)]  # a function word opens the text
    return first + [w for w in found if w[0].islower()]


FINAL = re.compile(r"[.!?。！？।॥৷．｡…][\s\"'”’」』）)\]]*$")


# Words by which languages in Latin script are told apart.
ENGLISH = frozenset("the of and was were is are that this with for from by at on had has have not but who whom what which it its he she they his her their them as while after before when where an be been would could until out up in to under into about because if then there than".split())
FOREIGN = frozenset(
    "zum zur vom beim ins ans le la les un une des du dans et ne pas jamais qui que est c'est l'a a n'a pour après avec sur elle il ils sont son sa ses cette au aux d'un der die das dem den des ein eine einen und nicht mit für von zu im am war ist es sie er auf "
    "el los las una y en no con por para que quien quién fue era al del se su junto después antes esperó ke ka ki ko ne mein se aur nahi nahin hai tha thi yah woh pata ghar ek bhi er ke kintu ebong na janto ta tar se jonno wa ga o ni de wo no kara made desu deshita ta mashita "
    "o os as um uma e não com por para il lo gli una e non con per di da che è het een van en niet met voor".split()
) - {"no", "in", "as", "a"}
# Words and endings that a name, thing or number doesn't end with or hold.
LINKING = {
    "en": frozenset("was were is are had has have and or but that which who whom until while when before after from to with without at in on by for under among out gave hid sold tore sang brought found left held rose wrote forgave refused feared waited learned dreamed walked searched off put".split()),
    "hi": frozenset("ने को में से पर और कि जब तक था थी थे है हैं गया गई गए के लिए बिना पहले बाद".split()),
    "bn": frozenset("ও আর যে যা যখন থেকে নিয়ে কাছে জন্য আগে পরে পর্যন্ত ছাড়াই করে হল ছিল গেল".split()),
}
LINKING_JA = re.compile(r"[はがをへ、。]|[にでと](?=[^ぁ-ゖ]|$)|(?:から|まで|より|について)|[っんし]$")
OMITTED = re.compile(r"(?:\.{2,}|…+|‥+|\[\s*(?:\.\.\.|…)\s*\]|\((?:cont|more)[^)]*\)?)\s*$")


def english(text: str) -> bool:
    """Whether text in Latin script is English, by its function words; short answers are taken as English."""
    own = latin_words(text)
    ours, theirs = sum(w in ENGLISH for w in own), sum(w.replace("’", "'") in FOREIGN for w in own)
    return theirs <= ours if ours or theirs else len(own) < 4


def other_language(text: str, lang: str) -> bool:
    share = script_share(QUOTED.sub(" ", text) if lang != "en" else text, lang)
    if share is None:
        return False
    return share < OWN_SCRIPT or lang == "en" and not english(text)


def is_name(text: str, lang: str) -> bool:
    """Whether a text without a final mark can be a name, thing or number."""
    plain = BRACKETED.sub(" ", text).strip()
    if lang == "ja":
        return len(plain) <= 16 and not LINKING_JA.search(plain)
    parts = plain.split()
    if len(parts) > 5 or any(p.strip(",;:") in LINKING.get(lang, ()) for p in parts):
        return False
    if plain.endswith((",", ";", ":", "-")):
        return False
    if lang == "en":
        low = [p for p in parts if p[0].islower()]
        return not low or len(low) <= 3 and parts[0].lower() in ("the", "a", "an") or all(p in ("of", "the", "de") for p in low)
    if lang == "bn":
        return len(parts) <= 3 and not re.search(r"-(?:এর|কে|এ|তে|র)$", plain) and not any(re.search(r"-(?:এর|কে|এ|তে|র)$", p) for p in parts[:-1])
    return len(parts) <= 3


def begins_sentence(text: str) -> bool:
    """Whether a short English text opens like a sentence rather than names a thing."""
    return bool(re.match(r"(?:A|An|The|On|In|At|That|While|During|After|Before|Many)\s", text)) and not re.match(r"The\s", text)


def defect(lang: str, prompt: str | None, response: str | None, known_whole: bool = False) -> str | None:
    """The kind of the response's defect, null for a usable pair. ``known_whole``: it stands elsewhere with a final mark."""
    if means_nothing(response):
        return "empty"
    own = words(response)
    if prompt and copied(words(prompt), own):
        return "copied"
    if refuses(response):
        return "refusal"
    if other_language(response, lang):
        return "other_language"
    text = re.sub(r"[\s　​]+$", "", response)
    if "�" in text[-2:]:
        return "truncated"
    if OMITTED.search(text):
        rest = OMITTED.sub("", text).strip()
        return None if known_whole or is_name(rest, lang) else "truncated"
    if FINAL.search(text):
        return None
    if known_whole or is_name(text, lang) and not (lang == "en" and begins_sentence(text)):
        return None
    return "truncated"


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), "[.!?。！？।॥৷．｡\\s]+$", ""))


#: Longest response that may be a name, thing or number.
SHORT = 40


def find_defects(pairs: DataFrame, *keys: str) -> DataFrame:
    """``keys, defect`` for the defective rows of ``pairs(keys, lang, prompt, response)``."""
    pairs = pairs.select(*keys, "lang", "prompt", "response")
    short = F.when(F.length("response") <= SHORT, _bare(F.col("response")))
    marked = (
        pairs.where(F.col("response").rlike("[.!?。！？।॥৷．｡]\\s*$"))
        .select("lang", short.alias("bare"))
        .where("bare rlike '[\\\\p{L}\\\\p{N}]'")
        .distinct()
        .withColumn("known", F.lit(True))
    )
    # only short responses are looked up; the others would all meet on the null key
    asked = pairs.withColumn("bare", short)
    looked_up = asked.where("bare is not null").join(marked, ["lang", "bare"], "left").select(*keys, "lang", "prompt", "response", "known")
    joined = looked_up.unionByName(asked.where("bare is null").select(*keys, "lang", "prompt", "response", F.lit(None).cast("boolean").alias("known")))
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [defect(*row) for row in zip(batch["lang"].fillna(""), batch["prompt"].where(batch["prompt"].notna(), None), batch["response"].where(batch["response"].notna(), None), batch["known"], strict=True)]
            out = batch[names].assign(defect=found)
            yield out[out.defect.notna()]

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", defect string"
    return joined.select(*keys, "lang", "prompt", "response", F.coalesce("known", F.lit(False)).alias("known")).mapInPandas(run, schema)
