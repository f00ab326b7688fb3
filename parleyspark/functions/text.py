"""Text functions as Column -> Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parleyspark import config as C


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(C.STRIP_CHARS))


def normalise(text: Column) -> Column:
    """Lower case, whitespace runs collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), C.SPACE_RUN, " "))


def fold_obfuscation(text: Column) -> Column:
    return F.translate(F.lower(text), C.OBFUSCATION_CHARS, "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def word_list(text: Column) -> Column:
    """Lower-cased alphanumeric words, the unit of the error-rate metrics."""
    return F.regexp_extract_all(F.lower(text), F.lit(C.WORD), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.TOKEN), F.lit(0))


def is_language_free(token: Column) -> Column:
    return token.rlike(C.LANGUAGE_FREE)


def content_tokens(token_array: Column) -> Column:
    kept = F.filter(token_array, lambda t: ~is_language_free(t))
    return F.transform(kept, lambda t: F.lower(t))


def content_token_count(text: Column) -> Column:
    """Content tokens, at least one for any non-blank text."""
    n = F.size(F.filter(tokens(text), lambda t: ~is_language_free(t)))
    return F.greatest(n, F.when(strip(text) != "", 1).otherwise(0)).cast("bigint")


def tag_string(token_array: Column, english: Iterable[str] = C.ENGLISH_WORDS, base: Iterable[str] = C.BASE_WORDS) -> Column:
    """One letter per token: u language-free, e English, h base language.

    A string keeps every later index (counts, switches) a plain string
    operation inside code generation instead of another array pass.
    """
    english_only = sorted(set(english) - set(base))
    letter = lambda t: (
        F.when(is_language_free(t), "u").when(F.lower(t).isin(english_only), "e").otherwise("h")
    )
    return F.array_join(F.transform(token_array, letter), "")


def count_letter(tags: Column, letter: str) -> Column:
    return (F.length(tags) - F.length(F.replace(tags, F.lit(letter), F.lit("")))).cast("bigint")


def switch_count(tags: Column) -> Column:
    """Language changes between neighbouring language tokens."""
    lang = F.replace(tags, F.lit("u"), F.lit(""))
    runs = F.regexp_replace(F.regexp_replace(lang, "h+", "h"), "e+", "e")
    return F.greatest(F.length(runs) - 1, F.lit(0)).cast("bigint")


def code_mix_index(n_base: Column, n_english: Column) -> Column:
    """100 * (1 - largest share); zero without two languages."""
    mixed = n_base + n_english
    share = F.greatest(n_base, n_english).cast("double") / mixed.cast("double")
    return F.when((n_base > 0) & (n_english > 0), F.lit(100.0) * (F.lit(1.0) - share)).otherwise(F.lit(0.0))


def multilingual_index(n_base: Column, n_english: Column) -> Column:
    total = n_base + n_english
    p = n_base.cast("double") / total.cast("double")
    q = F.lit(1.0) - p
    squares = p * p + q * q
    return F.when(total > 0, (F.lit(1.0) - squares) / squares).otherwise(F.lit(0.0))


def integration_index(switches: Column, n_base: Column, n_english: Column) -> Column:
    total = n_base + n_english
    return F.when(total >= 2, switches.cast("double") / (total - 1).cast("double")).otherwise(F.lit(0.0))


def with_mixing(df, text: str = "text", english=C.ENGLISH_WORDS, base=C.BASE_WORDS):
    """Add tags, counts and mixing indices computed from one tokenisation."""
    ratio = lambda k, n: F.when(n > 0, k.cast("double") / n.cast("double")).otherwise(F.lit(0.0))
    tagged = df.withColumn("tags", tag_string(tokens(F.col(text)), english, base))
    counted = tagged.withColumns(
        {
            "n_tokens": F.length("tags").cast("bigint"),
            "n_univ": count_letter(F.col("tags"), "u"),
            "n_en": count_letter(F.col("tags"), "e"),
            "n_hi": count_letter(F.col("tags"), "h"),
            "switches": switch_count(F.col("tags")),
        }
    )
    hi, en = F.col("n_hi"), F.col("n_en")
    return counted.withColumns(
        {
            "cmi": code_mix_index(hi, en),
            "m_index": multilingual_index(hi, en),
            "i_index": integration_index(F.col("switches"), hi, en),
            "en_frac": ratio(en, hi + en),
            "hi_frac": ratio(hi, hi + en),
        }
    )


def mix_bucket(cmi: Column) -> Column:
    names = C.CMI_BUCKETS
    return (
        F.when(cmi <= 1e-9, names[0])
        .when(cmi < 10, names[1])
        .when(cmi < 20, names[2])
        .when(cmi < 30, names[3])
        .otherwise(names[4])
    )


def padded_content(text: Column) -> Column:
    """Content tokens joined by single spaces with a space at both ends."""
    return F.concat(F.lit(" "), F.array_join(content_tokens(tokens(text)), " "), F.lit(" "))


def stem_hit(padded: Column, stem: str) -> Column:
    """Stem equals a token, or is its prefix with at most two extra letters."""
    tail = "[^ ]{0,2}" if len(stem) >= 4 else ""
    return padded.rlike(f" {stem}{tail} ")


def token_matches(token: Column, surfaces: Iterable[str]) -> Column:
    """Token carries a marker: equal to it, or starting with one of five letters or more."""
    surfaces = list(surfaces)
    clean = F.regexp_replace(fold_obfuscation(token), C.NOT_WORD_CHAR, "")
    hit = clean.isin(surfaces)
    for s in surfaces:
        if len(s) >= 5:
            hit = hit | clean.startswith(s)
    return hit


def may_have_marker(text: Column, surfaces: Iterable[str]) -> Column:
    """Cheap necessary test: a marker's letters with only symbols between them."""
    gap = r"[^\p{L}\p{N}\s\p{Z}]*"
    return text.rlike("(?iu)" + "|".join(gap.join(s) for s in surfaces))


def marker_positions(text: Column, surfaces: Iterable[str]) -> Column:
    """0-based indices of whitespace tokens that carry a marker."""
    surfaces = list(surfaces)
    parts = F.filter(F.split(text, C.SPACE_RUN), lambda t: t != "")
    indexed = F.transform(parts, lambda t, i: F.when(token_matches(t, surfaces), i))
    none = F.array().cast("array<int>")
    return F.when(may_have_marker(text, surfaces), F.filter(indexed, lambda i: i.isNotNull())).otherwise(none)


def clean_reply(raw: Column) -> Column:
    """Strip known prefixes in turn, keep the first non-blank line, unquote."""
    text = strip(F.coalesce(raw, F.lit("")))
    for prefix in C.REPLY_PREFIXES:
        text = strip(F.regexp_replace(text, f"(?i)^{prefix}", ""))
    unquote = lambda line: F.trim(F.trim(strip(line), F.lit('"')), F.lit("'"))
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), unquote), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def scrub(text: Column) -> Column:
    """Remove line-break markers, span elements and addresses."""
    out = F.replace(text, F.lit("[linebreak]"), F.lit(" "))
    out = F.regexp_replace(out, r"<span[^>]*>.*?</span>", " ")
    out = F.regexp_replace(out, r"https?://[^\s\p{Z}]+", " ")
    return F.trim(F.regexp_replace(out, C.SPACE_RUN, " "))


def strip_role(turn: Column) -> Column:
    return F.regexp_replace(turn, r"(?i)^\s*(?:[A-B]|speaker\s*\d)\s*[:：]\s*", "")


def strip_name(turn: Column, name: Column) -> Column:
    has = F.startswith(F.lower(turn), F.concat(F.lower(name), F.lit(":")))
    return F.when(has, strip(F.substr(turn, F.length(name) + 2))).otherwise(turn)


def english_heavy(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(C.LATIN_WORD), F.lit(0))
    n = F.size(words)
    function_words = F.size(F.filter(words, lambda w: F.lower(w).isin(C.ENGLISH_FUNCTION_WORDS)))
    return (n >= 4) & (function_words.cast("double") / F.greatest(n, F.lit(1)).cast("double") >= 0.35)


def devanagari_share(text: Column) -> Column:
    return count(text, C.DEVANAGARI).cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double")


def four_way_split(token_array: Column) -> Column:
    """Four contiguous pieces, earlier ones longer; NULL below eight tokens."""
    n = F.size(token_array)
    base, extra = F.floor(n / 4).cast("int"), (n % 4).cast("int")

    def piece(i):
        start = F.lit(i) * base + F.least(F.lit(i), extra) + 1
        size = base + F.when(F.lit(i) < extra, 1).otherwise(0)
        return F.array_join(F.slice(token_array, start, size), " ")

    return F.when(n >= 8, F.array(*[piece(i) for i in range(4)]))


def redacted(text: Column) -> Column:
    return F.concat(F.lit("[redacted:"), F.length(text).cast("string"), F.lit(" chars]"))


def place_seed(turns: Column, seed: Column, last: bool) -> Column:
    """Put the seed line into a chat: moved or appended last, else second."""
    wanted = normalise(seed)
    present = F.exists(turns, lambda t: normalise(t) == wanted)
    if last:
        return F.concat(F.filter(turns, lambda t: normalise(t) != wanted), F.array(seed))
    replaced = F.transform(turns, lambda t: F.when(normalise(t) == wanted, seed).otherwise(t))
    second = F.when(F.size(turns) >= 2, F.array_insert(turns, 2, seed)).otherwise(F.concat(F.array(seed), turns))
    return F.when(present, replaced).otherwise(second)


def alternate_speakers(length: Column, name_x: Column, name_y: Column) -> Column:
    """Speakers alternate so that the last turn is always by the first name."""
    last = (length - 1).cast("int")
    steps = F.sequence(F.lit(0), last)
    return F.transform(steps, lambda i: F.when((last - i) % 2 == 0, name_x).otherwise(name_y))


def context_turns(turns: Column) -> Column:
    return F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))


def pack_thread(turns: Column) -> Column:
    """Context turns, then the last turn, joined by role markers."""
    context = F.array_join(context_turns(turns), " [TURN] ")
    marked = F.concat(F.lit("[LAST] "), F.element_at(turns, -1))
    return F.when(context != "", F.concat(context, F.lit(" "), marked)).otherwise(marked)


def reversed_context(turns: Column) -> Column:
    """Second text segment of the pair input: context from newest to oldest."""
    return F.array_join(F.reverse(context_turns(turns)), " [TURN] ")


# --- fixed values: Devanagari letters and their ITRANS spelling --------------
CONSONANTS = dict(
    zip(
        "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह".split(),
        "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h".split(),
    )
)
VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ".split(), "a A i I u U RRi e ai o au".split()))
SIGNS = dict(zip("ा ि ी ु ू ृ े ै ो ौ".split(), "A i I u U RRi e ai o au".split()))
OTHERS = dict(zip("ं ः ँ ऽ ।".split(), "M H .N .a |".split()))


def romanise(text: Column) -> Column:
    """Lower-cased ITRANS spelling; non-Devanagari characters pass through.

    An inherent vowel follows each consonant without a vowel sign or virama.
    """
    letters = "".join(CONSONANTS)
    signs = "".join(SIGNS) + "्"
    voiced = F.regexp_replace(text, f"([{letters}])(?![{signs}])", "$1\u0001")
    table = {**CONSONANTS, **VOWELS, **SIGNS, **OTHERS, "्": "", "\u0001": "a"}
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    spelled = F.transform(F.split(voiced, ""), lambda ch: F.coalesce(mapping[ch], ch))
    plain = F.lower(F.array_join(spelled, ""))
    return F.when(text.rlike(C.DEVANAGARI), plain).otherwise(F.lower(text))
