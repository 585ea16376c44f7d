"""Seeded augmentation of serialised rows: the same row, seed and parameters give the same text.

Chances come from a hash of (seed, id, place), so reruns and lost tasks agree; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(seed: int, key: Column, *place: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), key, *place), F.lit(1 << 30)) / float(1 << 30)


def _shuffled(items: Column, seed: int, key: Column) -> Column:
    keyed = F.transform(items, lambda x, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _blocks(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"(?=\[BLK_)"), lambda b: F.trim(b) != ""), lambda b: F.trim(b))


def shuffle_blocks(text: Column, key: Column, seed: int) -> Column:
    return F.array_join(_shuffled(_blocks(text), seed, key), " ")


def _columns(block: Column) -> Column:
    return F.transform(F.filter(F.split(block, r"(?=\[COL\] )"), lambda c: F.trim(c) != ""), lambda c: F.trim(c))


def shuffle_columns(text: Column, key: Column, seed: int) -> Column:
    """Columns change places inside their block; what leads the block stays first."""

    def one(block: Column) -> Column:
        parts = _columns(block)
        lead = F.filter(parts, lambda p: ~p.startswith("[COL] "))
        return F.array_join(F.concat(lead, _shuffled(F.filter(parts, lambda p: p.startswith("[COL] ")), seed, key)), " ")

    return F.array_join(F.transform(_blocks(text), one), " ")


def mask_attributes(text: Column, key: Column, seed: int, p: float, protected: tuple[str, ...] = ()) -> Column:
    """Values become NULL with chance p, unless they are already or their column is protected."""

    def mask(part: Column, place: Column) -> Column:
        name = F.regexp_extract(part, r"^\[COL\] (.*?) \[VAL\] ", 1)
        hit = part.startswith("[COL] ") & ~name.isin(*protected, "") & (_unit(seed, key, place) < p)
        return F.when(hit, F.concat(F.lit("[COL] "), name, F.lit(" [VAL] NULL"))).otherwise(part)

    parts = F.flatten(F.transform(_blocks(text), _columns))
    return F.array_join(F.transform(parts, mask), " ")


def _special(word: Column) -> Column:
    return word.startswith("[")


#: Letters that a typing error may put in.
LETTERS = "abcdefghijklmnopqrstuvwxyzáéíóúüñ"
#: Columns that decide which rows are one entity.
PROTECTED = ("nombre", "NOMBRE_DEL_PACIENTE", "NOMBRE_COMPLETO", "expediente", "EXP", "EXPEDIENTE")


def _typo(word: Column, seed: int, p: float, *place: Column) -> Column:
    """With chance p, a word of two letters or more loses, gains, swaps or changes one letter."""
    n = F.char_length(word)
    at = (F.floor(_unit(seed + 1, *place) * n) + 1).cast("int")
    kind = F.floor(_unit(seed + 2, *place) * 4)
    new = F.substr(F.lit(LETTERS), (F.floor(_unit(seed + 3, *place) * len(LETTERS)) + 1).cast("int"), F.lit(1))
    head, letter, tail = F.substr(word, F.lit(1), at - 1), F.substr(word, at, F.lit(1)), F.substr(word, at + 1)
    swapped = F.concat(head, F.substr(word, at + 1, F.lit(1)), letter, F.substr(word, at + 2))
    changed = F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, new, letter, tail)).when((kind == 2) & (at < n), swapped).otherwise(F.concat(head, new, tail))
    return F.when((n > 1) & (_unit(seed, *place) < p), changed).otherwise(word)


def inject_typos(text: Column, key: Column, seed: int, p: float) -> Column:
    """Each word of a value, with chance p, is mistyped; names of columns, marks and NULL stay. A value's words get single spaces."""

    def one(part: Column, place: Column) -> Column:
        cut = F.instr(part, " [VAL] ")
        value = F.trim(F.substr(part, cut + 7))
        words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
        typed = F.array_join(F.transform(words, lambda w, i: _typo(w, seed, p, key, place, i)), " ")
        real = part.startswith("[COL] ") & (cut > 0) & ~value.isin("NULL", "")
        return F.when(real, F.concat(F.substr(part, F.lit(1), cut + 6), typed)).otherwise(part)

    parts = F.flatten(F.transform(_blocks(text), _columns))
    return F.array_join(F.transform(parts, one), " ")


def delete_span(text: Column, key: Column, seed: int, p: float, longest: int = 3) -> Column:
    """With chance p, up to `longest` words that are no marks and follow one another are dropped."""
    words = F.transform(F.split(text, " "), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    plain = F.transform(F.filter(words, lambda s: ~_special(s["w"])), lambda s: s["i"])
    n = (F.floor(_unit(seed + 1, key) * longest) + 1).cast("int")
    first = (F.floor(_unit(seed + 2, key) * F.greatest(F.size(plain) - n + 1, F.lit(1))) + 1).cast("int")
    gone = F.when((_unit(seed, key) < p) & (F.size(plain) > 0), F.slice(plain, first, n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(F.filter(words, lambda s: ~F.array_contains(gone, s["i"])), lambda s: s["w"]), " ")


def augment(text: Column, key: Column, seed: int, blocks: float = 0.3, columns: float = 0.3, mask: float = 0.25, typos: float = 0.25, span: float = 0.0, protected: tuple[str, ...] = PROTECTED) -> Column:
    """The steps in a fixed order. blocks, columns and span are chances for a row, mask one for each value, typos one for each word."""
    on = lambda k, p: _unit(seed + 100 * k, key) < p
    text = F.when(on(1, blocks), shuffle_blocks(text, key, seed)).otherwise(text)
    text = F.when(on(2, columns), shuffle_columns(text, key, seed)).otherwise(text)
    text = mask_attributes(text, key, seed + 300, mask, protected)
    text = inject_typos(text, key, seed + 400, typos)
    return delete_span(text, key, seed + 500, span) if span else text
