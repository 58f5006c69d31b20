"""Column functions over texts, times and keys. Columns in, columns out; dictionaries and limits are parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------------------------------------------------

#: Words per minute by language; others take DEFAULT_WPM.
LANGUAGE_WPM = {
    "en": 150, "hi": 120, "bn": 120, "ta": 110, "te": 115, "mr": 120, "gu": 120, "kn": 110, "ml": 105, "pa": 120,
    "ur": 120, "es": 160, "fr": 155, "de": 130, "ja": 200, "ko": 140, "zh": 160, "pt": 155, "ru": 130, "ar": 125,
    "it": 155, "tr": 130,
}
DEFAULT_WPM = 135
PUNCHY_WORDS = [
    "fight", "attack", "kill", "war", "battle", "danger", "power", "win", "lose", "destroy", "epic", "finally", "reveal",
    "shock", "now", "stop", "never", "defeat", "enemy", "blood", "scream", "boss", "rank", "unlock", "level",
    "लड़ाई", "हमला", "शक्ति", "जीत", "हार", "ताकत", "खतरा", "रहस्य", "अब",
]
EMOTIONAL_WORDS = [
    "love", "miss", "cry", "sad", "heart", "please", "sorry", "alone", "die", "remember", "dream", "hope", "fear", "truth",
    "promise", "mother", "father", "friend", "lost", "pain", "hurt", "tears", "farewell", "goodbye",
    "प्यार", "याद", "रोना", "दुख", "दिल", "माफ", "सच", "वादा", "अकेला", "दर्द",
]
COMEDIC_WORDS = [
    "funny", "joke", "laugh", "silly", "ridiculous", "seriously", "really", "unbelievable", "wait", "what", "huh", "dude",
    "bro", "man", "मज़ाक", "हँसी", "यार", "भाई", "सच में", "अरे",
]
BANNED_FORMAL = [
    "अतः", "किन्तु", "तथापि", "उक्त", "यद्यपि", "एवं", "आवश्यकता", "विक्षिप्त", "अथवा", "तत्पश्चात", "अतएव",
    "निश्चितरूपेण", "सर्वप्रथम", "तदुपरांत", "यथा", "किंचित", "प्रतीत", "उपरोक्त", "निम्नलिखित", "संदर्भ",
]
SPOKEN_DIGITS = {
    "0": "शून्य", "1": "एक", "2": "दो", "3": "तीन", "4": "चार", "5": "पाँच", "6": "छह", "7": "सात", "8": "आठ", "9": "नौ",
    "10": "दस", "11": "ग्यारह", "12": "बारह", "13": "तेरह", "14": "चौदह", "15": "पंद्रह", "20": "बीस", "25": "पच्चीस",
    "30": "तीस", "50": "पचास", "100": "सौ", "1000": "हज़ार",
}
DIGIT_LANGUAGES = ["hi", "mr", "bn", "gu", "pa", "ur"]
ABBREVIATIONS = [
    "mr.", "mrs.", "ms.", "dr.", "st.", "jr.", "sr.", "vs.", "etc.", "e.g.", "i.e.", "u.s.", "u.k.", "a.m.", "p.m.", "no.",
    "vol.", "fig.",
]
NOISE_WORDS = ["music", "applause", "laughter", "silence", "noise", "sound", "cheering", "singing"]
GARBAGE_MARKS = ["error 500", "server error", "that's an error", "<html", "<!doctype"]

# Words ---------------------------------------------------------------------------------------------------------------


def first_nonempty(*columns: Column | str) -> Column:
    """The first column that is neither null nor empty; null without columns."""
    return F.coalesce(F.lit(None).cast("string"), *(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def tokens(text: Column) -> Column:
    """White-space separated words; none for null."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    return F.size(tokens(text))


def count_words_nopunct(text: Column) -> Column:
    """Words left after removing all but letters, digits, underscores and white space."""
    return count_words(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Cleaning and predicates ---------------------------------------------------------------------------------------------


def normalize_word(text: Column) -> Column:
    """Trimmed, with straight apostrophes; bracketed or sung noise becomes empty."""
    t = F.trim(F.translate(text, "‘’", "''"))
    return F.when(t.rlike(r"^(\[.*\]|\(.*\)|♪.*♪)$"), "").otherwise(t)


def strip_inline_noise(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)\s*\[(" + "|".join(NOISE_WORDS) + r")\]\s*", " "))


def strip_markup(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"<[^>]+>", ""))


def is_garbage_translation(text: Column, short: bool = False) -> Column:
    """Null, blank, or an error page. short: the three marks of the word-chunk flow."""
    marks = [m for m in GARBAGE_MARKS if not (short and m == "that's an error")]
    low = F.lower(text)
    found = reduce(lambda a, m: a | low.contains(m), marks[1:], low.contains(marks[0]))
    return F.coalesce(F.trim(text) == "", F.lit(True)) | F.coalesce(found, F.lit(False))


def is_bad_translation(source: Column, out: Column) -> Column:
    """Empty, equal to the source, or under 30 % of a source of more than ten characters."""
    s, o = F.trim(F.coalesce(source, F.lit(""))), F.trim(F.coalesce(out, F.lit("")))
    return (o == "") | (o == s) | ((F.length(s) > 10) & (F.length(o) * 10 < F.length(s) * 3))


def is_bad_clip(size: Column, ms: Column) -> Column:
    return F.coalesce((size < 1000) | (ms < 200), F.lit(True))


def valid_language_code(code: Column) -> Column:
    return F.coalesce((code == "auto") | code.rlike(r"^[a-zA-Z]{2,5}(-[a-zA-Z]{2,5})?$"), F.lit(False))


def video_id_from_url(url: Column) -> Column:
    """The 11-character id of a watch, short, embed or shorts link; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def has_latin(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[A-Za-z]"), F.lit(False))


# Times ---------------------------------------------------------------------------------------------------------------


def parse_timecode(text: Column) -> Column:
    """HH:MM:SS with optional , or . and fraction, as ms; 0 where there are not three parts."""
    p = F.split(F.trim(F.replace(text, F.lit(","), F.lit("."))), ":")
    n = lambda k, kind: F.try_element_at(p, F.lit(k)).try_cast(kind)
    ms = (n(1, "bigint") * 3_600_000 + n(2, "bigint") * 60_000 + F.round(n(3, "decimal(12,3)") * 1000)).cast("bigint")
    return F.when(F.size(p) == 3, F.coalesce(ms, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def format_timecode(ms: Column, style: str = "srt") -> Column:
    """srt: HH:MM:SS,mmm; vtt: HH:MM:SS.mmm; clock: ss.mmm. Negative times count as 0. Times of a part of a
    millisecond are rounded or cut by the caller, as ms is whole."""
    t = F.greatest(ms.cast("bigint"), F.lit(0))
    if style == "clock":
        return F.concat(F.lpad(F.floor(t / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"))
    h, m, s = F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60
    return F.format_string("%02d:%02d:%02d" + ("." if style == "vtt" else ",") + "%03d", h, m, s, t % 1000)


def seconds(ms: Column) -> Column:
    return F.round(ms / 1000.0, 3)


def target_words(ms: Column, wpm: Column) -> Column:
    """max(1, duration in minutes times rate), halves to even."""
    return F.greatest(F.bround((ms * wpm).cast("double") / 60_000).cast("int"), F.lit(1))


# Transforms ----------------------------------------------------------------------------------------------------------


def _any(text: Column, marks: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))


def detect_emotion(text: Column, translated: Column, ms: Column) -> Column:
    low = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(translated, F.lit(""))))
    asks = F.length(F.regexp_replace(low, r"[^?]", ""))
    return (
        F.when((asks >= 2) | ((asks >= 1) & _any(low, COMEDIC_WORDS)), "comedic")
        .when(_any(low, EMOTIONAL_WORDS) | ((low.contains("...") | low.contains("…")) & (ms > 3000)), "emotional")
        .when(low.contains("!") | _any(low, PUNCHY_WORDS) | (ms < 2000), "punchy")
        .otherwise("neutral")
    )


def _longest_first(mapping: Mapping[str, str]) -> list[tuple[str, str]]:
    return sorted(mapping.items(), key=lambda kv: -len(kv[0]))


def replace_all(text: Column, mapping: Mapping[str, str]) -> Column:
    """Plain replacement, longest key first."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), _longest_first({k: v for k, v in mapping.items() if k}), text)


apply_pronunciation = replace_all
apply_glossary_replacement = replace_all


def formal_to_spoken(text: Column, mapping: Mapping[str, str], protected: Sequence[str] = (), anchored: bool = True) -> Column:
    """Dictionary replacement, longest key first; anchored keys must not touch a letter of the script's block."""
    for key, value in _longest_first(mapping):
        if key in protected:
            continue
        if anchored:
            text = F.regexp_replace(text, r"(?<![ँ-ॿ])\Q" + key + r"\E(?![ँ-ॿ])", value.replace("$", r"\$"))
        if not anchored or " " in key:
            text = F.replace(text, F.lit(key), F.lit(value))
    return text


def normalize_punct(text: Column) -> Column:
    """Doubled dandas, full stops behind the script's letters, repeated marks, and blanks before marks."""
    for pattern, new in [
        (r"।।", "।"), (r"।\.", "।"), (r"(?<=[ँ-ॿ])\.(?=\s|$)", "।"), (r",{2,}", ","), (r"।{2,}", "।"), (r"!{2,}", "!"),
        (r",\s*([।!?])", "$1"), (r"\s{2,}", " "), (r"\s+([।!?,])", "$1"),
    ]:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with a lambda's variable for the value, so that it is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shorten_by_substitution(text: Column, target: Column, substitutions: Mapping[str, str], fillers: Sequence[str] = (), protected: Sequence[str] = ()) -> Column:
    """While there are more words than target: substitutions by characters saved, then fillers, each at its first place;
    then the shortest clause between commas goes, and at last that between dandas. Of equal ones the last clause goes;
    the first, blank ones and clauses with a protected term stay, as do words that a substitution would take from or
    give to a protected term. A text is never cut within a clause, so it may stay longer than the target."""
    rules = [(k, v) for k, v in sorted(substitutions.items(), key=lambda kv: len(kv[1]) - len(kv[0])) if k and k not in protected and v not in protected]
    rules += [(f, "") for f in fillers if f]
    if rules:

        def apply(t: Column, rule: Column) -> Column:
            at = F.position(rule["old"], t)
            once = F.concat(F.substring(t, F.lit(1), at - 1), rule["new"], F.substring(t, at + F.length(rule["old"]), F.length(t)))
            return F.when((at > 0) & (count_words(t) > target), F.trim(F.regexp_replace(once, r"\s{2,}", " "))).otherwise(t)

        text = F.aggregate(F.array(*(F.struct(F.lit(k).alias("old"), F.lit(v).alias("new")) for k, v in rules)), text, apply)

    def without(t: Column, mark: str) -> Column:
        parts = F.split(t, mark)
        sized = F.transform(parts, lambda clause, k: F.struct(count_words(clause).alias("n"), (-k).alias("back"), clause.alias("clause")))
        locked = lambda c: F.exists(F.array(*map(F.lit, protected)), lambda p: F.contains(c, p)) if protected else F.lit(False)
        worst = F.array_min(F.filter(sized, lambda s: (s["back"] < 0) & (s["n"] > 0) & ~locked(s["clause"])))
        rest = lambda at: F.concat(F.slice(parts, F.lit(1), -at), F.slice(parts, 2 - at, F.size(parts)))
        joined = lambda at: F.trim(F.regexp_replace(F.array_join(rest(at), mark), r"\s{2,}", " "))
        ended = lambda x: F.when((x == "") | x.rlike(r"[।!?,]$"), x).otherwise(F.concat(x, F.lit("।")))
        shorter = _with(worst["back"], lambda at: F.when(at.isNotNull(), _with(joined(at), ended)).otherwise(t))
        return F.when(F.contains(t, F.lit(mark)) & (count_words(t) > target), shorter).otherwise(t)

    # a lambda's variable stands for the text, so that the expression does not repeat itself
    text = F.get(F.transform(F.array(text), lambda t: without(t, ",")), 0)
    return F.get(F.transform(F.array(text), lambda t: without(t, "।")), 0)


def compress_if_needed(text: Column, slot_ms: Column, substitutions: Mapping[str, str], fillers: Sequence[str] = (), wpm: int = 120, protected: Sequence[str] = ()) -> Column:
    """Shorten where the estimated speech is over 125 % of a slot of more than 0.3 s."""
    target = F.greatest(F.floor(slot_ms * 1.25 * wpm / 60_000).cast("int"), F.lit(3))

    def fitted(t: Column) -> Column:
        long = (count_words(t) * 60_000 / F.lit(wpm)) > slot_ms * 1.25
        return F.when((slot_ms > 300) & long, shorten_by_substitution(t, target, substitutions, fillers, protected)).otherwise(t)

    return _with(text, fitted)


def naturalness_score(text: Column, banned: Sequence[str] = BANNED_FORMAL) -> Column:
    t = tokens(text)
    formal = F.size(F.filter(F.array(*map(F.lit, banned)), lambda b: F.contains(text, b)))
    long = F.size(F.filter(t, lambda w: F.length(w) > 15))
    score = 1.0 - 0.15 * formal - F.when(F.length(text) > 200, 0.1).otherwise(0.0) - 0.05 * long
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def format_lines(text: Column, most: int = 42) -> Column:
    """One or two lines: cut at the mark nearest the middle within its half, else at the middle word."""
    n = F.length(text)
    marks = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.instr(F.lit(",।;"), F.substring(text, p, 1)) > 0)
    inside = F.filter(marks, lambda p: ((p - 1) * 4 > n) & ((p - 1) * 4 < n * 3))
    half = F.floor(n / 2).cast("int")
    nearest = F.array_min(F.transform(inside, lambda p: F.struct(F.abs(p - 1 - half).alias("d"), p.alias("p"))))["p"]
    words = tokens(text)
    middle = F.length(F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " "))
    cut = F.coalesce(nearest, middle)
    a, b = F.trim(F.substring(text, F.lit(1), cut)), F.trim(F.substring(text, cut + 1, n))
    fits = (a != "") & (b != "") & (F.length(a) <= most) & (F.length(b) <= most)
    return F.when((n <= most) | (F.size(words) < 4) | ~fits, text).otherwise(F.concat(a, F.lit("\n"), b))


def prepare_speech_text(text: Column, lang: Column, pronunciation: Mapping[str, str] | None = None) -> Column:
    """Pauses for ellipses and dashes, digits in words, a comma after each seven words without a mark, tidy ends."""
    t = F.regexp_replace(text, r"\.{2,}", ",")
    t = F.replace(F.replace(t, F.lit("—"), F.lit(", ")), F.lit("–"), F.lit(", "))
    spoken = t
    for digits, word in _longest_first(SPOKEN_DIGITS):
        spoken = F.regexp_replace(spoken, rf"(?<![\p{{L}}\p{{N}}_]){digits}(?![\p{{L}}\p{{N}}_])", word)
    t = F.when(lang.isin(DIGIT_LANGUAGES), spoken).otherwise(t)
    words = tokens(t)
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        ends, full = w.rlike(r"[,।!?]$"), acc["run"] + 1 >= 7
        run = F.when(ends | full, 0).otherwise(acc["run"] + 1)
        return F.struct(run.alias("run"), F.array_append(acc["out"], F.when(~ends & full, F.concat(w, F.lit(","))).otherwise(w)).alias("out"))

    paused = F.aggregate(words, start, step, lambda acc: F.array_join(acc["out"], " "))
    t = F.when(F.size(words) > 8, paused).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r",\s*,", ","), r",\s*([।!?])", "$1")
    return replace_all(F.regexp_replace(F.trim(t), r",+$", ""), pronunciation or {})


def simplify_for_retry(text: Column, attempt: Column) -> Column:
    """1: a comma in the middle of more than five words without one; 2: the first 80 %; 3: the first sentence or half."""
    words = tokens(text)
    n = F.size(words)
    half = F.floor(n / 2).cast("int")
    first = F.array_join(F.concat(F.slice(words, 1, half), F.array(F.lit(",")), F.slice(words, half + 1, F.greatest(n, F.lit(1)))), " ")
    one = F.when(~text.contains(",") & ~text.contains("।") & (n > 5), first).otherwise(text)
    two = F.array_join(F.slice(words, 1, F.greatest(F.floor(n * 0.8).cast("int"), F.lit(3))), " ")
    three = F.array_join(F.slice(words, 1, F.greatest(half, F.lit(3))), " ")
    for mark in ("?", "!", ".", "।"):
        part = F.trim(F.substring_index(text, mark, 1))
        three = F.when(text.contains(mark) & (F.length(part) > 5), F.concat(part, F.lit(mark))).otherwise(three)
    return F.when(attempt == 1, one).when(attempt == 2, two).otherwise(three)


def content_key(*columns: Column, sep: str = "\x1f", compat: bool = False) -> Column:
    """SHA-256 of the parts; compat joins them without a separator."""
    return F.sha2(F.concat_ws("" if compat else sep, *columns), 256)


def split_text_chunks(text: Column, most: int = 4500) -> Column:
    """Sentences joined greedily into chunks of at most `most` characters; a longer sentence stays whole."""
    sentences = F.filter(F.split(text, r"(?<=[.!?।])\s+"), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        fits = (F.size(acc) > 0) & (F.length(F.try_element_at(acc, F.lit(-1))) + 1 + F.length(s) <= most)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), s)))
        return F.when(fits, joined).otherwise(F.array_append(acc, s))

    return F.aggregate(sentences, F.array().cast("array<string>"), step)


def parse_numbered_lines(text: Column, n: Column) -> Column:
    """The texts behind `1.` or `1)` (and an optional [hint]) of a reply's lines, padded with '' or cut to n."""
    pattern = r"^\s*\d+[.)]\s*(?:\[[^\]]*\]\s*)?(.*)$"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d+[.)]"))
    found = F.transform(lines, lambda x: F.trim(F.regexp_extract(x, pattern, 1)))
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), n)), F.lit(1), n)
