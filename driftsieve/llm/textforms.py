"""Plain, canonical and hashed forms of texts.

These kernels run inside Arrow batches on the executors. They treat whole
texts; nothing is cut to a prefix.

* plain form: full-width and ideographic forms become ordinary ones, accents
  are composed, invisible characters go, special spaces become a space, and
  look-alike letters become letters of the text's own alphabet.
* canonical form: plain form, case-folded, only letters, digits and single
  spaces, trimmed.
* record keys: canonical forms of texts, and order-free keys of field records.

Nulls are treated as the empty text; a text of no letters stays as it is but
for spaces, widths and invisible characters.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

# Pairs (letter of the alphabet, letters that look like it).
LATIN_LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ",
    "Y": "ҮΥ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛգ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγү",
}
CYRILLIC_LOOKALIKES = {
    "А": "AΑ", "В": "BΒ", "Е": "EΕ", "З": "3", "К": "KΚ", "М": "MΜ", "Н": "HΗ", "О": "OΟՕ", "Р": "PΡ", "С": "CϹ",
    "Т": "TΤ", "У": "Y", "Х": "XΧ", "а": "aα", "е": "e", "о": "oοօ", "р": "pρ", "с": "cϲ", "у": "yγү", "х": "xχ",
    "к": "κ", "Ѕ": "S", "ѕ": "s", "І": "IΙ", "і": "i", "Ј": "J", "ј": "j",
}
GREEK_LOOKALIKES = {
    "Α": "AА", "Β": "BВ", "Ε": "EЕ", "Ζ": "Z", "Η": "HН", "Ι": "IІ", "Κ": "KК", "Μ": "MМ", "Ν": "N", "Ο": "OОՕ",
    "Ρ": "PР", "Τ": "TТ", "Υ": "YҮ", "Χ": "XХ", "ο": "oоօ", "ρ": "pр", "ν": "vѵ", "α": "aа", "γ": "yу", "χ": "xх",
}
del CYRILLIC_LOOKALIKES["З"]  # a digit is no letter


def _table(pairs: dict[str, str]) -> dict[int, str]:
    return {ord(x): to for to, those in pairs.items() for x in those}


def _chars(test) -> list[str]:
    return [chr(i) for i in [*range(0x20000), *range(0xE0000, 0xE0200)] if not 0xD800 <= i < 0xE000 and test(chr(i))]


def _span_class(chars: list[str]) -> str:
    """The inside of a character class that holds exactly these."""
    out, codes = [], sorted(map(ord, chars))
    start = last = codes[0]
    for c in codes[1:] + [None]:
        if c is not None and c == last + 1:
            last = c
            continue
        out.append(re.escape(chr(start)) + ("-" + re.escape(chr(last)) if last > start else ""))
        start = last = c
    return "".join(out)


_INVISIBLE = _chars(lambda c: unicodedata.category(c) == "Cf") + ["͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ"] + [chr(i) for i in range(0xFE00, 0xFE10)]
_SPACES = [c for c in _chars(lambda c: unicodedata.category(c) == "Zs") if c != " "]
_WIDE = [chr(i) for i in [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0), *range(0xFFE0, 0xFFE7)]]
_IDEOGRAPHIC = {"、": ",", "。": "."}

#: One pass of str.translate: invisible characters, spaces and widths.
_BASIC = {ord(c): None for c in _INVISIBLE} | {ord(c): " " for c in _SPACES} | {ord(c): unicodedata.normalize("NFKC", c) for c in _WIDE} | {ord(k): v for k, v in _IDEOGRAPHIC.items()}
_NEEDS_BASIC = re.compile("[" + _span_class([*_INVISIBLE, *_SPACES, *_WIDE, *_IDEOGRAPHIC]) + "]")
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿֑-ׇً-゙゚ٟ]")
#: Letters of another alphabet than plain Latin that may stand for one, or the other way round.
_FOREIGN = re.compile("[ıɐ-ʯͰ-֏]")

_TO = {"latin": _table(LATIN_LOOKALIKES), "cyrillic": _table(CYRILLIC_LOOKALIKES), "greek": _table(GREEK_LOOKALIKES)}
_AMBIGUOUS = {chr(k) for t in _TO.values() for k in t} | {c for t in (LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES) for c in t}
_OWN = {
    "latin": re.compile("[" + _span_class([c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]) if c.isalpha() and c not in _AMBIGUOUS]) + "]+"),
    "cyrillic": re.compile("[" + _span_class([c for c in map(chr, range(0x400, 0x530)) if c.isalpha() and c not in _AMBIGUOUS]) + "]+"),
    "greek": re.compile("[" + _span_class([c for c in map(chr, range(0x370, 0x400)) if c.isalpha() and c not in _AMBIGUOUS]) + "]+"),
}
_ANY = {"latin": re.compile("[A-Za-zÀ-ɏ]+"), "cyrillic": re.compile("[Ѐ-ԯ]+"), "greek": re.compile("[Ͱ-Ͽ]+")}
_SWAPS = {k: re.compile("[" + _span_class([chr(c) for c in t]) + "]") for k, t in _TO.items()}


def alphabet(text: str) -> str:
    """The alphabet of most letters that only one alphabet has; of most letters if there are none such; Latin in a tie."""
    for classes in (_OWN, _ANY):
        counts = {k: sum(map(len, p.findall(text))) for k, p in classes.items()}
        best = max(counts, key=counts.get)
        if counts[best]:
            return best
    return "latin"


#: What a character asks for: 1 the basic pass, 2 a look at the alphabet, 4 composing; 8, 16, 32 letters that only one alphabet has.
_FLAGS = np.zeros(sys.maxunicode + 1, np.uint8)
for _bit, _pattern in ((1, _NEEDS_BASIC), (2, _FOREIGN), (4, _MARKS)):
    for _c in [*range(0x20000), *range(0xE0000, 0xE0200)]:
        if _pattern.match(chr(_c)):
            _FLAGS[_c] |= _bit
for _bit, _name in ((8, "latin"), (16, "cyrillic"), (32, "greek")):
    for _c in range(0x600):
        if _OWN[_name].match(chr(_c)):
            _FLAGS[_c] |= _bit


def _repair(text: str, flags: int, own: str | None) -> str:
    if flags & 1:
        text = text.translate(_BASIC)
    if flags & 2:
        own = own or alphabet(text)
        if own == "latin":
            # A look-alike may carry the accent as one character with it, so letters are taken apart first.
            return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TO[own]))
        if _SWAPS[own].search(text):
            text = text.translate(_TO[own])
        return unicodedata.normalize("NFC", text) if flags & 5 else text
    return unicodedata.normalize("NFC", text) if flags & 5 else text


def plain_batch(texts: list[str | None]) -> list[str]:
    """Texts in one consistent form. Null gives the empty text; tabs, line breaks and numbers of spaces stay."""
    out = [t or "" for t in texts]
    at = [i for i, t in enumerate(out) if not t.isascii()]
    if not at:
        return out
    codes = np.frombuffer("".join(out[i] for i in at).encode("utf-32-le", "replace"), np.uint32)
    flags = _FLAGS[codes]
    lengths = np.fromiter((len(out[i]) for i in at), np.int64, len(at))
    starts = np.cumsum(lengths) - lengths
    each = np.bitwise_or.reduceat(flags, starts)
    for k in np.flatnonzero(each & 7):
        i, f = at[k], int(each[k])
        own = None
        if f & 2:
            # Full-width letters are Latin ones, so they don't change which of the others lead.
            mine = flags[starts[k] : starts[k] + lengths[k]]
            counts = {n: int(np.count_nonzero(mine & b)) for n, b in (("latin", 8), ("cyrillic", 16), ("greek", 32))}
            best = max(counts, key=counts.get)
            own = best if counts[best] and not f & 1 else None
        out[i] = _repair(out[i], f, own)
    return out


def plain_form(text: str | None) -> str:
    return plain_batch([text])[0]


_END = "\U0010ffff"
_KEEP = np.zeros(sys.maxunicode + 1, np.uint32)
for _c in range(0x34000):  # the planes that have letters
    if chr(_c).isalnum():
        _KEEP[_c] = _c
    elif chr(_c).isspace():
        _KEEP[_c] = 32
_KEEP[ord(_END)] = ord(_END)


def canonical_batch(plains: list[str]) -> list[str]:
    """Case-folded letters, digits and single spaces of plain forms."""
    if not plains:
        return []
    joined = _END.join(plains)
    if joined.count(_END) >= len(plains):
        joined = _END.join(p.replace(_END, "") for p in plains)
    codes = _KEEP[np.frombuffer(joined.casefold().encode("utf-32-le", "replace"), np.uint32)]
    codes = codes[codes != 0]
    space = codes == 32
    if len(codes):
        edge = space | (codes == ord(_END))
        drop = space.copy()
        drop[1:] &= edge[:-1]  # a space after a space or an end; the first character, if a space
        last = space.copy()
        last[:-1] &= codes[1:] == ord(_END)
        codes = codes[~(drop | last)]
    return [t.rstrip(" ") for t in codes.tobytes().decode("utf-32-le").split(_END)]


def canonical(plain: str) -> str:
    return canonical_batch([plain])[0]


def letters_only(plain: str) -> str:
    """Case-folded letters and digits of a plain form."""
    return "".join(filter(str.isalnum, plain.casefold()))


_SEGMENTS = re.compile(r"[\n\r|;]+")


def record_key(plain: str) -> str | None:
    """An order-free key of a field record, None for other texts.

    A field record has at least three segments `field: value`, parted by line breaks, | or ;, and nothing else.
    """
    if plain.count(":") < 3:
        return None
    pairs, n = set(), 0
    for part in _SEGMENTS.split(plain):
        if not part.strip():
            continue
        field, colon, value = part.partition(":")
        if not colon:
            if not letters_only(part):
                continue
            return None
        f, v = letters_only(field), letters_only(value)
        if not f:
            return None
        n += 1
        pairs.add(f + ":" + v)
    return "\x1f".join(sorted(pairs)) if n >= 3 else None


def enough(plain: str, least: int = 20) -> bool:
    """Whether a text has at least that many letters and digits."""
    if len(plain) < least:
        return False
    n = 0
    for c in plain:
        n += c.isalnum()
        if n >= least:
            return True
    return False


# ---------------------------------------------------------------- windows

_B = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads them, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(texts: list[str], width: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of `width` characters of all texts, end to end.

    Returns the hashes, and each text's first position and number of windows. A shorter text has one window, itself.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    padded = [t if len(t) >= width else t.ljust(width, "\0") for t in texts] if len(texts) and lengths.min() < width else texts
    lengths = np.maximum(lengths, width)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes += np.uint64(1)
    codes = mix(codes)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    counts = lengths - (width - 1)
    if not len(codes):
        return np.empty(0, np.uint64), starts, counts
    # doubling: runs of 1, 2, 4, ... characters, put together by the bits of the width
    run, size, done, total = codes, 1, None, 0
    while True:
        if width & size:
            done = run if done is None else done[: len(run) - total] * _power(size) + run[total : total + len(done)] if total else run
            total += size
        if size * 2 > width:
            break
        run = run[:-size] * _power(size) + run[size:]
        size *= 2
    h = mix(done.copy())
    pad = np.empty(len(codes), np.uint64)
    pad[: len(h)] = h
    pad[len(h) :] = 0
    return pad, starts, counts
