"""Text columns: tokens, keys, hashes, safety and privacy classes. All are Column expressions; null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of questions that evidence tokens leave out.
STOP_WORDS = ("a", "an", "and", "are", "do", "does", "i", "is", "me", "my", "of", "please", "tell", "the", "to", "user", "what", "you", "your")

# Own pattern lists for credentials, instruction injection and personal data, in a dialect that both
# engines read.
CREDENTIAL = r"(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S{6,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"
INJECTION = r"(?i)(ignore|disregard|forget) (all|any|the|your) (previous|prior|above) (instructions|rules)|system prompt|act as (a|an) "
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?[0-9][0-9() -]{8,}[0-9]|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"

#: Strictness, least first.
SENSITIVITIES = ("normal", "private", "secret")
SHARES = ("allow-remote", "local-only", "never")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalised(c: Column | str, most: int = 1000) -> Column:
    """Full-width forms folded, control characters and runs of spaces as one space, trimmed, cut."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(x) for x in range(0x21, 0x7F)) + " "
    return F.substring(F.trim(F.regexp_replace(F.translate(_text(c), wide, narrow), r"[\p{Cntrl}\s]+", " ")), 1, most)


def comparable(c: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}]+", "")


def name_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))


def sentence_key(c: Column | str) -> Column:
    return F.regexp_replace(name_key(c), r"[.!?。！？]+$", "")


def lexical_tokens(c: Column | str) -> Column:
    """w: words of [a-z0-9], c: Han characters, b: pairs of Han characters that follow one another, whatever stands between;
    duplicates stay."""
    text = _text(c)
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: F.concat(F.lit("w:"), w))
    han = F.regexp_extract_all(text, F.lit(r"[\x{3400}-\x{9fff}]"), 0)
    ones = F.transform(han, lambda x: F.concat(F.lit("c:"), x))
    # side by side, as a function of each place that reads the array would make it again at each place
    pairs = F.zip_with(F.slice(han, 1, F.greatest(F.size(han) - 1, F.lit(0))), F.slice(han, 2, F.greatest(F.size(han) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, b))
    return F.concat(words, ones, pairs)


def word_tokens(c: Column | str) -> Column:
    """The words of lexical_tokens alone, without their mark: for Latin corpora."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), 0)


def evidence_tokens(c: Column | str) -> Column:
    """lexical_tokens without single Han characters and stop words."""
    stops = [f"w:{w}" for w in STOP_WORDS]
    return F.filter(lexical_tokens(c), lambda t: ~F.startswith(t, F.lit("c:")) & ~t.isin(*stops))


def is_safe(c: Column | str) -> Column:
    """False for empty texts, credentials and instruction injection."""
    text = _text(c)
    return (F.trim(text) != "") & ~text.rlike(CREDENTIAL) & ~text.rlike(INJECTION)


def privacy(c: Column | str) -> Column:
    """(sensitivity, share): private and local-only when personal data occurs."""
    personal = _text(c).rlike(PERSONAL)
    return F.struct(
        F.when(personal, "private").otherwise("normal").alias("sensitivity"), F.when(personal, "local-only").otherwise("allow-remote").alias("share")
    )


def rank_in(order: tuple[str, ...], c: Column | str) -> Column:
    """Place in an order of strictness; unknown values are the strictest."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*(F.when(col == v, F.lit(i)) for i, v in enumerate(order)), F.lit(len(order) - 1))


def at_rank(order: tuple[str, ...], rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in order)), rank + 1)


def stable_id(namespace: str, *parts: Column | str, length: int = 24) -> Column:
    """Prefix of the SHA-256 of the namespace and the parts, joined by a line end."""
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(namespace), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)), 256), 1, length)


def fnv1a32(c: Column | str) -> Column:
    """FNV-1a over the UTF-16 units of a text of the basic plane, as a 32-bit number in a long."""
    codes = F.transform(F.filter(F.split(_text(c), ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


#: Occurrences that one tag counts for in a hashed embedding.
TAG_WEIGHT = 5


def feature_terms(c: Column | str, tags: Column | None = None) -> Column:
    """What a hashed embedding counts, with repeats: lexical_tokens, g: the character triples of words of four or more
    letters, and s: tags, each TAG_WEIGHT times."""
    triples = F.flatten(
        F.transform(
            F.filter(word_tokens(c), lambda w: F.length(w) >= 4),
            lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.lit("g:"), F.substring(w, i, F.lit(3)))),
        )
    )
    terms = F.concat(lexical_tokens(c), triples)
    if tags is None:
        return terms
    return F.concat(terms, F.flatten(F.transform(tags, lambda t: F.array_repeat(F.concat(F.lit("s:"), t), TAG_WEIGHT))))


def hashed_terms(c: Column | str, dims: int = 384, tags: Column | None = None) -> Column:
    """Signed buckets of feature_terms: array of (dim, sign), one for each occurrence; their sums by dim, unit-scaled, are the
    hashed embedding."""
    return F.transform(
        F.transform(feature_terms(c, tags), fnv1a32),
        lambda h: F.struct((h % dims).cast("int").alias("dim"), F.when(h.bitwiseAND(F.lit(0x80000000)) != 0, -1).otherwise(1).alias("sign")),
    )


# Words that requirement tokens leave out, and the patterns of questions about everything known of a person.
REQUIREMENT_STOPS = ("我的", "关于", "什么", "哪些", "用户", "记得", "分别", "the", "what", "about", "remember")
BROAD_PATTERNS = (
    "(?:我的|关于我|对我的|我过去|我以前|我这些年).{0,20}(?:哪些|所有|全部|总结|概括|回顾|偏好|习惯|经历|变化|历史|过去一年|多方面|分别|列出|信息|事情|记忆)",
    "(?:总结|概括|回顾|列出|说说).{0,20}(?:我的|关于我|对我的|我过去|我以前|我这些年|你记得我的)",
    "你(?:还)?记得我.{0,12}(?:什么|哪些|多少|事情|信息|记忆)",
    r"(?:my|about\s+me|what\s+you\s+(?:remember|know)\s+about\s+me).{0,32}(?:anything|everything|all|summary|summari[sz]e|preferences|habits|history|changes|facts|memories)",
    r"(?:summary|summari[sz]e|list|recap).{0,32}(?:my|about\s+me|what\s+you\s+(?:remember|know)\s+about\s+me)",
)


def _pairs(runs: Column) -> Column:
    """The neighbouring pairs of signs in every run of an array."""
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def requirement_tokens(c: Column | str) -> Column:
    """Distinct Latin words of two signs or more, Han runs of two or more, and their pairs, without REQUIREMENT_STOPS."""
    low = F.lower(_text(c))
    runs = F.regexp_extract_all(low, F.lit(r"[\x{3400}-\x{9fff}]{2,}"), 0)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9._-]+"), 0)
    return F.array_except(F.array_distinct(F.concat(words, runs, _pairs(runs))), F.array(*(F.lit(s) for s in REQUIREMENT_STOPS)))


def feedback_tokens(c: Column | str) -> Column:
    """Distinct Latin words of two signs or more, and the pairs of Han runs."""
    low = F.lower(_text(c))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9@._+-]{2,}"), 0), _pairs(F.regexp_extract_all(low, F.lit(r"[\x{3400}-\x{9fff}]{2,}"), 0))))


def is_broad(c: Column | str) -> Column:
    """Whether a question asks for everything known of a person."""
    return F.lower(_text(c)).rlike("|".join(BROAD_PATTERNS))
