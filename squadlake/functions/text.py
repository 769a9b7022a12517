"""Names and free text: everything stays a column expression."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generational suffixes and first-name short forms.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
NICKNAMES = {
    "mitch": "mitchell", "mike": "michael", "chris": "christopher",
    "matt": "matthew", "josh": "joshua", "nick": "nicholas",
    "cam": "cameron", "zach": "zachary", "zack": "zachary", "ben": "benjamin",
    "alex": "alexander", "jon": "jonathan", "will": "william",
    "tony": "anthony", "dan": "daniel", "danny": "daniel", "joe": "joseph",
    "tom": "thomas", "ken": "kenneth", "kenny": "kenneth", "pat": "patrick",
}

# Body-part vocabulary, most specific first, and side markers in the order they are tried.
BODY_PARTS = (
    ("hamstring", r"(?i)\b(hamstring|hammy|ham)\b"),
    ("knee", r"(?i)\b(knee|mcl|acl|meniscus)\b"),
    ("ankle", r"(?i)\b(ankle|high ankle|achilles)\b"),
    ("shoulder", r"(?i)\b(shoulder|ac joint|labrum)\b"),
    ("concussion", r"(?i)\b(concussion|head|protocol)\b"),
)
SIDES = (r"(?i)\((L|R)\)", r"(?i)^(L|R)\s", r"(?i)\b(left|right)\b")

_WS = r"[\s\x1c-\x1f]"


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """(chars, replacements) of one-letter compatibility folds, and the longer folds."""
    singles_from, singles_to, longer = [], [], {}
    for code in range(0x80, 0x1FBFF):
        ch = chr(code)
        kept = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode() if not 0xD800 <= code < 0xE000 else ""
        if len(kept) == 1:
            singles_from.append(ch)
            singles_to.append(kept)
        elif kept:
            longer[ch] = kept
    return "".join(singles_from), "".join(singles_to), longer


def ascii_fold(c: Column) -> Column:
    """Compatibility-decompose and keep ASCII: accents go, ligatures spell out.

    Plain ASCII text (nearly all of it) skips both tables; only text holding a
    character that folds to several letters takes the per-character path.
    """
    src, dst, longer = _folds()
    pairs = "\x02".join(f"{ch}\x03{spelling}" for ch, spelling in longer.items())
    many = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x03"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(many, ch), ch)), "")
    has_longer = c.rlike("[" + "".join(longer) + "]")
    expanded = F.when(has_longer, spelled).otherwise(c)
    folded = F.regexp_replace(F.translate(expanded, src, dst), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def clean_name(c: Column, nicknames: bool = True) -> Column:
    """Join key of a person's name: case, accents, punctuation, order and suffix removed."""
    s = _strip(ascii_fold(c))
    halves = F.split(s, ",", 2)
    s = F.when(s.contains(","), F.concat(_strip(halves[1]), F.lit(" "), _strip(halves[0]))).otherwise(s)
    s = _strip(F.regexp_replace(F.regexp_replace(F.lower(s), r"[.'`]", ""), f"{_WS}+", " "))
    tokens = F.filter(F.split(s, " "), lambda t, i: (i == 0) | ~t.isin(*SUFFIXES))
    if nicknames:
        formal = F.str_to_map(F.lit(",".join(f"{short}:{full}" for short, full in NICKNAMES.items())))
        tokens = F.transform(tokens, lambda t, i: F.when(i == 0, F.coalesce(F.try_element_at(formal, t), t)).otherwise(t))
    return F.coalesce(F.array_join(tokens, " "), F.lit(""))


def split_name(clean: Column) -> tuple[Column, Column]:
    """(first token, rest) of a cleaned name."""
    return F.substring_index(clean, " ", 1), F.regexp_extract(clean, r"^[^ ]* (.*)$", 1)


def body_part(raw: Column, side_field: Column) -> tuple[Column, Column, Column]:
    """(canonical part, side, where the side came from)."""
    part = None
    for canon, pattern in BODY_PARTS:
        part = F.when(raw.rlike(pattern), canon) if part is None else part.when(raw.rlike(pattern), canon)
    in_text = F.coalesce(*[F.when(raw.rlike(p), F.upper(F.left(F.regexp_extract(raw, p, 1), F.lit(1)))) for p in SIDES])
    blank = raw.isNull() | (raw == "")
    fielded = side_field.isin("L", "R")
    given = side_field.isNotNull() & (side_field != "")
    side = F.when(blank | fielded, side_field).otherwise(in_text)
    source = (F.when(blank, F.when(given, "field")).when(fielded, "field")
               .otherwise(F.when(in_text.isNotNull(), "text")))
    return F.when(~blank, part), side, source
