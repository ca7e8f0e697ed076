"""Text. Lengths and places count code points; case changes are ASCII only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import Val, merge, number_text, parse_number, serial_date, to_bool, to_num, to_text, when_bad
from .math import half_away
from .registry import fn, python, raw

VALUE, NA = "#VALUE!", "#N/A"
LIMIT = 32_767

fn("LEN LENB", "t")(lambda s: F.length(s))
fn("UPPER", "t", "t")(lambda s: F.translate(s, string.ascii_lowercase, string.ascii_uppercase))
fn("LOWER", "t", "t")(lambda s: F.translate(s, string.ascii_uppercase, string.ascii_lowercase))
fn("TRIM", "t", "t")(lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
fn("CLEAN", "t", "t")(lambda s: F.regexp_replace(s, r"[\x00-\x1F]", ""))
fn("EXACT", "tt", "b")(lambda a, b: a == b)
fn("CONCAT CONCATENATE", "t*", "t")(lambda *s: F.concat(*s))
fn("ASC", "t", "t")(lambda s: F.translate(s, "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " "))
fn("UNICODE CODE", "t")(lambda s: (F.when(s != "", F.ascii(s)).otherwise(0), when_bad(s == "", VALUE)))
fn("CHAR", "n", "t")(lambda n: (F.char(F.floor(n)), when_bad((n < 1) | (n >= 256), VALUE)))
python("UNICHAR", "n", "t")(lambda n: chr(int(n)) if n >= 1 else chr(-1))


@fn("LEFT LEFTB", "tn", "t", defaults=(1.0,))
def _(s, n):
    return F.substring(s, F.lit(1), F.floor(n).cast("int")), when_bad(n < 0, VALUE)


@fn("RIGHT RIGHTB", "tn", "t", defaults=(1.0,))
def _(s, n):
    k = F.least(F.floor(n).cast("int"), F.length(s))
    return F.when(k <= 0, "").otherwise(F.substring(s, F.length(s) - k + 1, k)), when_bad(n < 0, VALUE)


@fn("MID MIDB", "tnn", "t")
def _(s, at, n):
    return F.substring(s, F.floor(at).cast("int"), F.floor(n).cast("int")), when_bad((at < 1) | (n < 0), VALUE)


@fn("REPLACE REPLACEB", "tnnt", "t")
def _(s, at, n, new):
    at, n = F.floor(at).cast("int"), F.floor(n).cast("int")
    return F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + n, F.greatest(F.length(s), F.lit(1)))), when_bad((at < 1) | (n < 0), VALUE)


@fn("REPT", "tn", "t")
def _(s, n):
    ok = (n >= 0) & (F.length(s) * F.floor(n) <= LIMIT)
    return F.repeat(s, F.when(ok, F.floor(n).cast("int")).otherwise(0)), when_bad(~ok, VALUE)


@raw("SUBSTITUTE", 3, 4)
def _(s, old, new, nth=None):
    s, old, new = to_text(s), to_text(old), to_text(new)
    err = merge(s.err, old.err, new.err)
    if nth is None:
        return Val(F.when(old.v == "", s.v).otherwise(F.replace(s.v, old.v, new.v)), "t", err)
    n = to_num(nth)
    k = F.floor(n.v).cast("int")
    # the parts before and after the nth place, each joined again by the old text
    pieces = _split(s.v, old.v)
    total = F.size(pieces) - 1
    joined = F.concat(_joined(F.slice(pieces, F.lit(1), F.greatest(k, F.lit(1))), old.v), new.v, _joined(F.slice(pieces, F.greatest(k, F.lit(1)) + 1, F.size(pieces)), old.v))
    return Val(F.when((old.v == "") | (total < k), s.v).otherwise(joined), "t", merge(err, n.err, when_bad(n.v < 1, VALUE)))


def _split(s: Column, by: Column) -> Column:
    return F.split(s, F.concat(F.lit(r"\Q"), by, F.lit(r"\E")), -1)


def _joined(parts: Column, by: Column) -> Column:
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), F.get(parts, F.lit(0)), lambda a, b: F.concat(a, by, b))


@fn("FIND FINDB", "ttn", defaults=(1.0,))
def _(what, s, at):
    rest = F.substring(s, F.floor(at).cast("int"), F.greatest(F.length(s), F.lit(1)))
    place = F.position(what, rest)
    return F.when(place > 0, place + F.floor(at) - 1).otherwise(0), when_bad((place == 0) | (at < 1) | (at > F.length(s) + 1), VALUE)


@fn("SEARCH SEARCHB", "ttn", defaults=(1.0,))
def _(what, s, at):
    rest = F.lower(F.substring(s, F.floor(at).cast("int"), F.greatest(F.length(s), F.lit(1))))
    quoted = F.concat(F.lit(r"\Q"), F.lower(what), F.lit(r"\E"))
    for wild, meaning in (("?", "."), ("*", ".*?")):
        quoted = F.replace(quoted, F.lit(wild), F.lit(rf"\E{meaning}\Q"))
    quoted = F.concat(F.lit("(?s)"), quoted)
    place = F.when(F.regexp_like(rest, quoted), F.length(F.element_at(F.split(rest, quoted, 2), 1)) + 1).otherwise(0)
    return F.when(place > 0, place + F.floor(at) - 1).otherwise(0), when_bad((place == 0) | (at < 1) | (at > F.length(s) + 1), VALUE)


def _beside(after: bool):
    def body(s, by, nth=None):
        s, by = to_text(s), to_text(by)
        n = to_num(nth) if nth is not None else Val(F.lit(1.0), "n")
        k = F.floor(n.v).cast("int")
        pieces = _split(s.v, by.v)
        count = F.size(pieces) - 1
        cut = F.when(k > 0, k).otherwise(count + k + 1)  # pieces before the chosen delimiter
        ok = (cut >= 1) & (cut <= count)
        cut = F.when(ok, cut).otherwise(1)
        part = F.slice(pieces, cut + 1, F.size(pieces)) if after else F.slice(pieces, F.lit(1), cut)
        err = merge(s.err, by.err, n.err, when_bad((by.v == "") | (k == 0), VALUE), when_bad(~ok, NA))
        return Val(_joined(part, by.v), "t", err)

    return body


raw("TEXTBEFORE", 2, 3)(_beside(False))
raw("TEXTAFTER", 2, 3)(_beside(True))


@raw("TEXTJOIN", 3)
def _(by, skip, *items):
    by, skip, items = to_text(by), to_bool(skip), [to_text(i) for i in items]
    all_ = F.array(*[i.v for i in items])
    kept = F.when(skip.v, F.filter(all_, lambda x: x != "")).otherwise(all_)
    return Val(F.coalesce(_joined(kept, by.v), F.lit("")), "t", merge(by.err, skip.err, *[i.err for i in items]))


fn("PROPER", "t", "t")(lambda s: F.element_at(F.transform(F.array(F.lower(s)), lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1)), lambda w: F.initcap(w)), "")), 1))


@raw("VALUE", 1, 1)
def _(x):
    return to_num(x)


@fn("NUMBERVALUE", "ttt", defaults=(".", ","))
def _(s, point, group):
    n = parse_number(F.replace(F.replace(F.replace(s, F.lit(" "), F.lit("")), group, F.lit("")), point, F.lit(".")))
    return F.when(s == "", 0.0).otherwise(F.coalesce(n, F.lit(0.0))), when_bad((s != "") & n.isNull(), VALUE)


def _fixed(x: Column, d: Column, commas: bool) -> Column:
    scale = F.pow(F.lit(10.0), F.floor(d))
    r = half_away(x * scale) / scale
    out = None
    for k in range(0, 16):
        f = F.format_number(r, k)
        out = F.when(F.floor(d) == k, f) if out is None else out.when(F.floor(d) == k, f)
    out = out.otherwise(F.format_number(r, 0))
    return out if commas else F.replace(out, F.lit(","), F.lit(""))


@fn("FIXED", "nnb", "t", defaults=(2.0, False))
def _(x, d, plain):
    return F.when(plain, _fixed(x, d, False)).otherwise(_fixed(x, d, True))


@fn("DOLLAR", "nn", "t", defaults=(2.0,))
def _(x, d):
    money = F.concat(F.lit("$"), _fixed(F.abs(x), d, True))
    return F.when(x < 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(money)


#: Date letters of TEXT formats and their patterns.
DATE_FORMATS = {"yyyy-mm-dd": "yyyy-MM-dd", "dd/mm/yyyy": "dd/MM/yyyy", "mm/dd/yyyy": "MM/dd/yyyy", "yyyy": "yyyy", "mmm": "MMM", "mmmm": "MMMM", "mm/yyyy": "MM/yyyy", "yyyy-mm": "yyyy-MM", "d": "d", "dd": "dd"}


@raw("TEXT", 2, 2)
def _(x, fmt):
    n, f = to_num(x), to_text(fmt)
    v = number_text(n.v)
    for name, pattern in DATE_FORMATS.items():
        v = F.when(F.lower(f.v) == name, F.date_format(serial_date(n.v), pattern)).otherwise(v)
    for d in range(0, 6):
        zeros = "0" + ("." + "0" * d if d else "")
        v = F.when(f.v == zeros, _fixed(n.v, F.lit(d), False)).when(f.v == "#,##" + zeros, _fixed(n.v, F.lit(d), True)).when(f.v == zeros + "%", F.concat(_fixed(n.v * 100, F.lit(d), False), F.lit("%"))).otherwise(v)
    return Val(v, "t", merge(n.err, f.err))


@raw("VALUETOTEXT", 1, 2)
def _(x, mode=None):
    s = to_text(x)
    return Val(F.concat(F.lit('"'), s.v, F.lit('"')) if mode is not None and x.kind == "t" else s.v, "t", s.err)



def _letters(n: Column) -> Column:
    """Column letters of a number up to 18278."""
    n = F.floor(n) - 1
    last = F.char(65 + n % 26)
    middle = F.when(n >= 26, F.char(65 + (F.floor(n / 26) - 1) % 26)).otherwise("")
    first = F.when(n >= 702, F.char(65 + (F.floor((F.floor(n / 26) - 1) / 26) - 1) % 26)).otherwise("")
    return F.concat(first, middle, last)


@fn("ADDRESS", "nnnbt", "t", defaults=(1.0, True, ""))
def _(row, column, kind, a1, sheet):
    """kind: 1 both parts fixed, 2 the row, 3 the column, 4 none."""
    whole = lambda n: F.floor(n).cast("long").cast("string")
    dollar = lambda fixed: F.when(kind.isin(*fixed), "$").otherwise("")
    a = F.concat(dollar((1.0, 3.0)), _letters(column), dollar((1.0, 2.0)), whole(row))
    part = lambda letter, n, fixed: F.concat(F.lit(letter), F.when(kind.isin(*fixed), whole(n)).otherwise(F.concat(F.lit("["), whole(n), F.lit("]"))))
    r1c1 = F.concat(part("R", row, (1.0, 2.0)), part("C", column, (1.0, 3.0)))
    plain = sheet.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")
    prefix = F.when(sheet == "", "").when(plain, F.concat(sheet, F.lit("!"))).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'!")))
    bad = (row < 1) | (column < 1) | (row > 1048576) | (column > 16384) | ~F.floor(kind).isin(1, 2, 3, 4)
    return F.concat(prefix, F.when(a1, a).otherwise(r1c1)), when_bad(bad, VALUE)
