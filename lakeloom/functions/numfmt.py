"""Number formatting from a specifier: [[fill]align][sign][symbol][0][width][,][.precision][~][type]."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import fresh_name, let_text, of_text, quoted

#: The specifier grammar and the SI prefixes.
_SPEC = re.compile(r"^(?:(.)?([<>=^]))?([+\-( ])?([$#])?(0)?(\d+)?(,)?(?:\.(\d+))?(~)?([a-z%])?$", re.IGNORECASE)
PREFIXES = "y z a f p n µ m  k M G T P E Z Y".split(" ")


@dataclass(frozen=True)
class Spec:
    fill: str = " "
    align: str = ">"
    sign: str = "-"
    symbol: str = ""
    zero: bool = False
    width: int = 0
    comma: bool = False
    precision: int | None = None
    trim: bool = False
    type: str = ""


def parse(text: str) -> Spec:
    m = _SPEC.match(text)
    if not m:
        raise ValueError(f"invalid format: {text!r}")
    fill, align, sign, symbol, zero, width, comma, precision, trim, kind = m.groups()
    return Spec(fill or " ", align or ">", sign or "-", symbol or "", bool(zero), int(width or 0), bool(comma), int(precision) if precision else None, bool(trim), kind or "")


#: Limbs of exact integers are below this; so are the factors they are multiplied by.
_LIMB = 10**9
#: Powers that one multiplication takes: 5 ** 12 and 2 ** 29 are the largest below a limb.
_STEPS = {5: 12, 2: 29}
#: Doubles below this have exact whole parts and halves, and those from _NORMAL on have all their bits.
_EXACT = f"{2**52}D"
_NORMAL = "2.2250738585072014E-308D"

# A format is one expression of some hundred parts. It is put together as SQL text, which Spark reads
# at once; building it from Columns takes a call for each part, seconds for a few formats.


def _pair(digits: str, power: str) -> str:
    return f"named_struct('digits', {digits}, 'power', {power})"


def _binary(x: str) -> str:
    """(m, e) of a positive finite double x = m * 2 ** e."""
    part = lambda t, n: f"regexp_extract({t}, r'0x([01])[.]([0-9a-f]+)p(-?[0-9]+)', {n})"
    return let_text(f"format_string('%a', {x})", lambda t: f"named_struct('m', try_cast(conv(concat({part(t, 1)}, {part(t, 2)}), 16, 10) as bigint), 'e', try_cast({part(t, 3)} as int) - 4 * length({part(t, 2)}))")


def _times(limbs: str, factor: str) -> str:
    """A number in limbs, lowest first, times a factor below a limb."""
    s, v = fresh_name(), fresh_name()
    step = let_text(f"{v} * {factor} + {s}.carry", lambda t: f"named_struct('carry', {t} div {_LIMB}, 'out', concat({s}.out, array({t} % {_LIMB})))")
    return f"aggregate({limbs}, named_struct('carry', 0L, 'out', cast(array() as array<bigint>)), ({s}, {v}) -> {step}, {s} -> concat({s}.out, array({s}.carry)))"


def _exact(x: str) -> str:
    """(digits, power): all decimal digits of a positive finite double, and the power of ten of the first.

    m * 2 ** e is m * 5 ** -e with the point moved for a negative e. The product is built in limbs
    of nine digits, so no size or precision is out of reach.
    """

    def digits(b: str) -> str:
        n, limbs, factor, limb = f"abs({b}.e)", fresh_name(), fresh_name(), fresh_name()
        full = lambda base: f"array_repeat({base ** _STEPS[base]}L, int({n} div {_STEPS[base]}))"
        rest = lambda base: "element_at(array(" + ", ".join(f"{base**i}L" for i in range(_STEPS[base])) + f"), int({n} % {_STEPS[base]}) + 1)"
        factors = f"if({b}.e < 0, concat({full(5)}, array({rest(5)})), concat({full(2)}, array({rest(2)})))"
        product = f"aggregate({factors}, array({b}.m % {_LIMB}, {b}.m div {_LIMB}), ({limbs}, {factor}) -> {_times(limbs, factor)})"
        text = f"regexp_replace(array_join(transform(reverse({product}), {limb} -> lpad(string({limb}), 9, '0')), ''), '^0+', '')"
        return let_text(text, lambda t: _pair(t, f"length({t}) - 1 - if({b}.e < 0, {n}, 0)"))

    return let_text(_binary(x), digits)


def _rounded(digits: str, keep: str, least: str = "5") -> str:
    """The first `keep` of exact digits, rounded up if the next is `least` or more; one digit more if the first one is carried over."""

    def cut(t: str) -> str:
        more = lambda stem: f"if({stem} = '', '1', concat(substr({stem}, 1, length({stem}) - 1), string(int(right({stem}, 1)) + 1)))"
        raised = lambda head: let_text(f"regexp_replace({head}, '9+$', '')", lambda stem: f"concat({more(stem)}, repeat('0', length({head}) - length({stem})))")
        return let_text(f"substr({t}, 1, {keep})", lambda head: f"case when {keep} < 0 then '0' when substr({t}, {keep} + 1, 1) >= '{least}' then {raised(head)} when {head} = '' then '0' else {head} end")

    return let_text(f"concat({digits}, repeat('0', greatest({keep} + 1 - length({digits}), 0)))", cut)


def _first(d: str, digits: str, least: str = "5") -> str:
    """(digits, power) of exact digits, rounded to so many."""
    return let_text(_rounded(f"{d}.digits", digits, least), lambda t: _pair(f"substr({t}, 1, {digits})", f"{d}.power + if(length({t}) > {digits}, 1, 0)"))


def _read(shown: str) -> str:
    """(digits, power) of a number in the form d.ddde+00."""
    return _pair(f"replace(substring_index({shown}, 'e', 1), '.', '')", f"try_cast(substring_index({shown}, 'e', -1) as int)")


def _significant(x: str, digits: int) -> str:
    """(digits, power) of a non-negative finite number: its first digits, rounded on its exact value, halves up, and the power of ten of the first.

    Java prints up to 17 digits, fewer of the smallest numbers. Those settle the matter if what
    follows the last one asked for is clearly off a half.
    """
    slow = let_text(_exact(x), lambda d: _first(d, str(digits)))
    near = min(4, 17 - digits)
    if near >= 2:
        tail = f"substr(replace(substring_index(format_string('%.16e', {x}), 'e', 1), '.', ''), {digits + 1})"
        quick = let_text(f"format_string('%.{digits - 1}e', {x})", _read)
        slow = f"if({x} < {_NORMAL} or {tail} rlike '^(4{'9' * (near - 1)}|5{'0' * (near - 1)})', {slow}, {quick})"
    return f"if({x} = 0, {_pair(repr('0' * digits), '0')}, {slow})"


def _shortest(x: str, d: str) -> str:
    """(digits, power) of a positive number, from its exact digits: the fewest that give it back.

    Above a power of two doubles lie twice as far apart as below, so the nearest number of so many
    digits may miss it where the next one up does not.
    """
    n, t = fresh_name(), fresh_name()
    lengths = f"if({x} < {_NORMAL}, sequence(1, 17), array(15, 16, 17))"
    back = f"double(concat(left({t}.digits, 1), '.', substr({t}.digits, 2), 'e', string({t}.power))) = {x}"
    tried = f"flatten(transform({lengths}, {n} -> array({_first(d, n)}, {_first(d, n, '0')})))"
    return let_text(f"get(filter({tried}, {t} -> {back}), 0)", lambda f: _pair(f"regexp_replace({f}.digits, '(?<=.)0+$', '')", f"{f}.power"))


def _placed(d: str, less: str = "0") -> str:
    """Digits with a decimal point, without an exponent; less: powers of ten that something else stands for."""
    digits, power, n = f"{d}.digits", f"({d}.power - {less})", f"length({d}.digits)"
    return f"case when {power} < 0 then concat('0.', repeat('0', -{power} - 1), {digits}) when {power} >= {n} - 1 then concat({digits}, repeat('0', {power} - {n} + 1)) else concat(substr({digits}, 1, {power} + 1), '.', substr({digits}, {power} + 2)) end"


def _exponential(d: str) -> str:
    return f"concat(left({d}.digits, 1), if(length({d}.digits) > 1, concat('.', substr({d}.digits, 2)), ''), 'e', if({d}.power < 0, '-', '+'), string(abs({d}.power)))"


def _plain_of(x: str, d: str) -> str:
    return let_text(_shortest(x, d), lambda t: f"if({t}.power >= 21 or {t}.power < -6, {_exponential(t)}, {_placed(t)})")


def _plain(x: str) -> str:
    """The shortest text of a non-negative finite number: without an exponent from 1e-6 up to 1e21.

    No two numbers of 15 digits are the same double, so one that gives x back is the shortest.
    """
    shown = lambda t: f"if({t}.power >= 21 or {t}.power < -6, {_exponential(t)}, {_placed(t)})"
    bare = lambda t: let_text(_read(t), lambda d: _pair(f"regexp_replace({d}.digits, '(?<=.)0+$', '')", f"{d}.power"))
    slow = let_text(_exact(x), lambda d: _plain_of(x, d))
    other = let_text(f"format_string('%.14e', {x})", lambda t: f"if({x} >= {_NORMAL} and double({t}) = {x}, {let_text(bare(t), shown)}, {slow})")
    return f"if({x} < 1e15D and {x} = floor({x}), string(floor({x})), {other})"


def _fixed(x: str, digits: int) -> str:
    """Decimal text of a non-negative finite number, rounded on its exact value, halves up; from 1e21 on the shortest text.

    A product that is far from a half and below 2 ** 52 is settled in doubles, all others exactly.
    """

    def pointed(whole: str) -> str:
        at = lambda t: f"concat(substr({t}, 1, length({t}) - {digits}), '.', right({t}, {digits}))"
        return let_text(f"lpad({whole}, greatest(length({whole}), {digits + 1}), '0')", at) if digits else whole

    scaled = f"({x} * 1e{digits}D)"
    sure = f"{scaled} < {_EXACT} and abs({scaled} - floor({scaled}) - 0.5D) > {scaled} * {2.0**-50!r}D"
    exact = lambda d: let_text(_rounded(f"{d}.digits", f"({d}.power + {1 + digits})"), pointed)
    slow = let_text(_exact(x), lambda d: f"if({x} >= 1e21D, {_plain_of(x, d)}, {exact(d)})")
    return f"if({sure}, {let_text(f'string(bigint(floor({scaled} + 0.5D)))', pointed)}, {slow})"


def _si(x: str, digits: int) -> str:
    """Significant digits with an SI prefix; below 1y only those that the place leaves, the shortest ones if that is none."""

    def shown(d: str) -> str:
        third, left = f"int(greatest(-8, least(8, floor({d}.power / 3))))", f"({d}.power + {24 + digits})"
        few = let_text(_exact(x), lambda e: f"if({left} > 0, {_rounded(f'{e}.digits', left)}, {_shortest(x, e)}.digits)")
        names = "array(" + ", ".join(map(repr, PREFIXES)) + ")"
        return f"concat(if({d}.power < -24, concat('0.', repeat('0', -{d}.power - 25), {few}), {_placed(d, f'{third} * 3')}), element_at({names}, {third} + 9))"

    return let_text(_significant(x, digits), shown)


def _general(x: str, digits: int) -> str:
    return let_text(_significant(x, digits), lambda d: f"if({d}.power < -6 or {d}.power >= {digits}, {_exponential(d)}, {_placed(d)})")


def _trimmed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, r'([.][0-9]*?)0+(?![0-9])', '$1'), r'[.](?![0-9])', '')"


def _grouped(whole: str, sizes: tuple[int, ...], comma: str = ",") -> str:
    """Commas between groups of these sizes from the right; the last size repeats."""

    def parts(back: str) -> str:
        taken, first, part = 0, [], fresh_name()
        for size in sizes[:-1]:
            first.append(f"substr({back}, {taken + 1}, {size})")
            taken += size
        rest = f"regexp_extract_all(substr({back}, {taken + 1}), '.{{1,{sizes[-1]}}}', 0)"
        return f"reverse(array_join(filter(concat(array({', '.join(first)}), {rest}), {part} -> {part} <> ''), {quoted(comma)}))"

    return let_text(f"reverse({whole})", parts)


#: Bits of a digit.
_RADIX = {"b": 1, "o": 3, "x": 4, "X": 4}


def _whole(x: str) -> str:
    """The nearest whole number of a non-negative one below 2 ** 52, halves up."""
    return f"(bigint(floor({x})) + if({x} - floor({x}) >= 0.5D, 1, 0))"


def _radix(x: str, kind: str) -> str:
    """Digits of the nearest whole number to base 2, 8 or 16; large doubles are a small number times a power of two."""
    bits = _RADIX[kind]
    digits = lambda n: f"conv(string({n}), 10, {2**bits})"
    high = let_text(_binary(x), lambda b: f"concat({digits(f'{b}.m * bigint(pow(2, {b}.e % {bits}))')}, repeat('0', int({b}.e div {bits})))")
    out = f"if({x} < {_EXACT}, {digits(_whole(x))}, {high})"
    return f"lower({out})" if kind == "x" else out


_DECIMAL = {"e": lambda a, n: let_text(_significant(a, n + 1), _exponential), "f": _fixed, "g": _general, "r": lambda a, n: let_text(_significant(a, n), _placed), "s": _si}
_PERCENT = {"%": _fixed, "p": lambda a, n: let_text(_significant(a, n), _placed)}
_TYPES = {*_RADIX, *_DECIMAL, *_PERCENT, "d", "c"}


def fixed(x: Column, digits: int) -> Column:
    """Decimal text of a non-negative finite number, rounded on its exact value, halves up."""
    return of_text(x.cast("double"), lambda v: _fixed(v, digits))


def plain(x: Column) -> Column:
    """The shortest text of a non-negative finite number: without an exponent from 1e-6 up to 1e21."""
    return of_text(x.cast("double"), _plain)


def group(text: Column, sizes: tuple[int, ...] = (3,), comma: str = ",") -> Column:
    """Commas in the whole part of a number's text, between groups of these sizes from the right; the last size repeats."""
    whole = lambda t: f"regexp_extract({t}, '^[0-9]*', 0)"
    return of_text(text, lambda t: f"concat({_grouped(whole(t), sizes, comma)}, substr({t}, length({whole(t)}) + 1))")


def format_number(x: Column, spec: str, groups: tuple[int, ...] = (3,), currency: tuple[str, str] = ("$", "")) -> Column:
    """Types % b c d e f g n o p r s x X and none, any other is an error; null stays null.

    Digits are rounded on the exact value, halves away from zero; a precision is 20 at most for the
    types % e f, and from 1 to 21 for g p r s. NaN is "NaN", an infinite number "Infinity". A
    negative number shown as zero has no sign, unless + is asked for.

    groups: digits between commas, from the right; currency: what stands before and after for $.
    """
    s = parse(spec)
    kind, trim, comma, digits = s.type, s.trim, s.comma, 6 if s.precision is None else s.precision
    if kind == "n":
        kind, comma = "g", True
    elif kind == "":
        kind, trim, digits = "g", True, 12 if s.precision is None else s.precision
    if kind not in _TYPES:
        raise ValueError(f"unknown type in {spec!r}")
    digits = max(1, min(21, digits)) if kind in ("g", "p", "r", "s") else min(20, digits)

    def body(a: str) -> str:
        if kind in _RADIX:
            return _radix(a, kind)
        if kind == "d":
            return f"if({a} < {_EXACT}, string({_whole(a)}), {_plain(a)})"
        return _plain(a) if kind == "c" else (_PERCENT if kind in _PERCENT else _DECIMAL)[kind](a, digits)

    def shown(v: str) -> str:
        inner = let_text(f"abs({v})" + (" * 100" if kind in _PERCENT else ""), lambda a: f"case when isnan({a}) then 'NaN' when {a} = double('infinity') then 'Infinity' else {body(a)} end")
        return let_text(_trimmed(inner) if trim else inner, lambda b: _dressed(v, b, s, kind, comma, groups, currency))

    return of_text(x.cast("double"), shown)


def _dressed(x: str, body: str, s: Spec, kind: str, comma: bool, groups: tuple[int, ...], currency: tuple[str, str]) -> str:
    """A number's digits with sign, symbols, groups and padding."""
    zero = s.zero or (s.fill == "0" and s.align == "=")
    below = f"({x} < 0 or string({x}) = '-0.0')"
    negative = below if s.sign == "+" else f"({below} and ({body} = 'Infinity' or regexp_replace({body}, 'e[+-].*$', '') rlike '[1-9a-fA-F]'))"
    if kind == "c":  # the whole text is an ending: nothing is grouped, its sign is its own
        rest, number, negative = f"concat(if({x} < 0, '-', ''), {body})", "''", "false"
    elif kind in _RADIX:
        rest, number = "''", body
    else:
        number = f"regexp_extract({body}, '^[0-9]*', 0)"
        rest = f"substr({body}, length({number}) + 1)"
    symbol = currency[0] if s.symbol == "$" else "0" + kind.lower() if s.symbol == "#" and kind in _RADIX else ""
    ending = currency[1] if s.symbol == "$" else "%" if kind in _PERCENT else ""
    opening, closing = ("(", ")") if s.sign == "(" else ("-", "")
    before = f"concat(if({negative}, {quoted(opening)}, {quoted(s.sign if s.sign in '+ ' else '')}), {quoted(symbol)})"
    after = f"concat({rest}, {quoted(ending)}, if({negative}, {quoted(closing)}, ''))"

    def padded(t: str) -> str:
        room = f"({s.width} - length({t}.before) - length({t}.after))"
        grouped = _grouped(f"{t}.body", groups) if comma else f"{t}.body"
        if zero:
            filled = f"lpad({t}.body, greatest(length({t}.body), {room}), '0')"
            if comma:
                wide = f"({s.width} - length({t}.after))"
                cut = let_text(_grouped(filled, groups), lambda g: f"if(startswith(right({g}, {wide}), ','), right({g}, {wide} + 1), right({g}, {wide}))")
                filled = f"if({room} > length({t}.body), {cut}, {grouped})"
            return f"concat({t}.before, {filled}, {t}.after)"

        def spaced(b: str) -> str:
            gap = f"greatest({room} - length({b}), 0)"
            fill = lambda n: f"repeat({quoted(s.fill)}, int({n}))"
            all_ = f"{t}.before, {b}, {t}.after"
            if s.align == "<":
                return f"concat({all_}, {fill(gap)})"
            if s.align == "^":
                return f"concat({fill(f'floor({gap} / 2)')}, {all_}, {fill(f'{gap} - floor({gap} / 2)')})"
            if s.align == "=":
                return f"concat({t}.before, {fill(gap)}, {b}, {t}.after)"
            return f"concat({fill(gap)}, {all_})"

        return let_text(grouped, spaced)

    return let_text(f"named_struct('before', {before}, 'body', {number}, 'after', {after})", padded)


def format_prefix(x: Column, spec: str, exponent: int) -> Column:
    """Fixed digits of x in units of one SI prefix: that of the power of ten `exponent`."""
    third = max(-8, min(8, exponent // 3))
    number = format_number(x * F.lit(float(10 ** (-third * 3)) if third <= 0 else 1 / 10 ** (third * 3)), re.sub("[a-zA-Z%]?$", "f", spec, count=1))
    return F.concat(number, F.lit(PREFIXES[third + 8]))


def _exponent(x: Column) -> Column:
    return F.floor(F.log10(F.abs(x)) + 1e-12)


def precision_fixed(step: Column) -> Column:
    """Fraction digits that tell values a step apart."""
    return F.greatest(F.lit(0), -_exponent(step))


def precision_round(step: Column, most: Column) -> Column:
    """Significant digits for values up to `most`, a step apart."""
    return F.greatest(F.lit(0), _exponent(F.abs(most) - F.abs(step)) - _exponent(step)) + 1
