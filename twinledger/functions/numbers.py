"""Number text as SQL expressions: canonical doubles and exact fixed-point formatting."""

from __future__ import annotations

from decimal import Decimal

from twinledger.functions.text import bind, literal

_DIGITS = r"\d+(?:_\d+)*"
_SPACE = r"[ \t\n\x0B\f\r]*"
_NUMBER = literal(
    rf"^{_SPACE}[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?{_SPACE}$"
)
_SPECIAL = literal(rf"(?i)^{_SPACE}[+-]?(?:inf(?:inity)?|nan){_SPACE}$")

_TWO_53 = "9007199254740992D"
_TWO_63 = "9223372036854775808D"
_INFINITY = "CAST('Infinity' AS DOUBLE)"
_SPLITTER = 2**27 + 1


def _not_finite(x: str) -> str:
    return (
        f"CASE WHEN isnan({x}) THEN 'nan' WHEN {x} = {_INFINITY} THEN 'inf' "
        f"WHEN {x} = -{_INFINITY} THEN '-inf' END"
    )


def _without_exponent(text: str, scale: int) -> str:
    digits = f"rtrim('0', CAST(try_cast({text} AS DECIMAL(38,{scale})) AS STRING))"
    return bind(digits, "we", "CASE WHEN endswith(we, '.') THEN concat(we, '0') ELSE we END")


def _with_exponent(text: str) -> str:
    mantissa = f"regexp_replace(substring_index({text}, 'E', 1), {literal(r'\.0$')}, '')"
    power = f"substring_index({text}, 'E', -1)"
    sign = f"CASE WHEN startswith({power}, '-') THEN 'e-' ELSE 'e+' END"
    digits = f"regexp_replace(ltrim('-', {power}), {literal(r'^(\d)$')}, '0$1')"
    return f"concat({mantissa}, {sign}, {digits})"


_LIMB = 10**9
"""Exact values are held as limbs of nine digits, the lowest first."""

_FIVES = "array(" + ", ".join(f"{5**k}L" for k in range(13)) + ")"


def _times(limbs: str, factor: str) -> str:
    """Limbs times a factor below one limb; the product of a limb and it fits 64 bits."""
    step = (
        f"named_struct('out', concat(ls.out, array(pmod(ld * ({factor}) + ls.carry, {_LIMB}L))), "
        f"'carry', (ld * ({factor}) + ls.carry) div {_LIMB}L)"
    )
    end = "CASE WHEN ls.carry > 0 THEN concat(ls.out, array(ls.carry)) ELSE ls.out END"
    start = "named_struct('out', CAST(array() AS ARRAY<BIGINT>), 'carry', 0L)"
    return f"aggregate({limbs}, {start}, (ls, ld) -> {step}, ls -> {end})"


def _exact_digits(x: str, body: str) -> str:
    """``body`` over ``xd``: all digits of a positive finite double and the power of ten they are times.

    The double is a 53-bit integer times a power of two, as its hexadecimal text tells. The integer
    is multiplied up: by 2^e, or by 5^-e with 10^e left over.
    """
    mantissa = (
        "CAST(conv(concat(substring(xh, 3, 1), "
        "rpad(substring_index(substring_index(xh, 'p', 1), '.', -1), 13, '0')), 16, 10) AS BIGINT)"
    )
    power = "CAST(substring_index(xh, 'p', -1) AS INT) - 52"
    split = f"named_struct('m', {mantissa}, 'e', {power})"
    start = f"array(xb.m % {_LIMB}L, xb.m div {_LIMB}L)"
    twos = _times("lx", "shiftleft(1L, least(29, xb.e - 29 * li))")
    fives = _times("lx", f"element_at({_FIVES}, CAST(least(12, -xb.e - 12 * li) + 1 AS INT))")
    limbs = (
        f"CASE WHEN xb.e >= 0 THEN aggregate(sequence(0, xb.e div 29), {start}, (lx, li) -> {twos}) "
        f"ELSE aggregate(sequence(0, -xb.e div 12), {start}, (lx, li) -> {fives}) END"
    )
    digits = (
        f"ltrim('0', array_join(transform(reverse({limbs}), lz -> lpad(CAST(lz AS STRING), 9, '0')), ''))"
    )
    result = f"named_struct('digits', {digits}, 'power', least(xb.e, 0))"
    return bind(f"format_string('%a', {x})", "xh", bind(split, "xb", bind(result, "xd", body)))


def _shortest(x: str) -> str:
    """Digits and exponent (of the first digit) of the shortest decimal that reads back as ``x > 0``.

    For each number of digits the two decimals around the exact value are tried, the nearer one first.
    """
    padded = "concat(xd.digits, repeat('0', 18))"
    rest = f"substring({padded}, sn + 1)"
    above = f"({rest} > '5' AND rtrim('0', {rest}) <> '5')"
    head = f"CAST(substring({padded}, 1, sn) AS BIGINT)"
    pair = f"named_struct('near', {head} + int({above}), 'far', {head} + int(NOT {above}))"
    scale = "'E', length(xd.digits) + xd.power - sn"
    hit = (
        f"CASE WHEN CAST(concat(sp.near, {scale}) AS DOUBLE) = {x} THEN sp.near "
        f"WHEN CAST(concat(sp.far, {scale}) AS DOUBLE) = {x} THEN sp.far END"
    )
    found = bind(
        bind(pair, "sp", hit), "sh",
        "CASE WHEN sh IS NOT NULL THEN named_struct('digits', rtrim('0', CAST(sh AS STRING)), "
        "'exponent', length(xd.digits) + xd.power - 1 + length(CAST(sh AS STRING)) - sn) END",
    )
    first = (
        f"aggregate(sequence(1, 17), CAST(NULL AS STRUCT<digits: STRING, exponent: INT>), "
        f"(sa, sn) -> CASE WHEN sa IS NULL THEN {found} ELSE sa END)"
    )
    return _exact_digits(x, first)


def _scientific(x: str) -> str:
    """``1.5e+16`` style of a positive finite double.

    A text of the JVM of up to 15 digits is the only one so short for a normal number; longer ones
    may have a digit too many or not be the nearest, and are sought from the exact value.
    """
    mantissa = (
        "CASE WHEN length(ss.digits) > 1 THEN concat(substring(ss.digits, 1, 1), '.', substring(ss.digits, 2)) "
        "ELSE ss.digits END"
    )
    power = "lpad(CAST(abs(ss.exponent) AS STRING), greatest(2, length(CAST(abs(ss.exponent) AS STRING))), '0')"
    sought = f"concat({mantissa}, CASE WHEN ss.exponent < 0 THEN 'e-' ELSE 'e+' END, {power})"
    text = f"CAST({x} AS STRING)"
    return (
        f"CASE WHEN {x} >= 2.2250738585072014E-308D AND length(substring_index({text}, 'E', 1)) <= 16 "
        f"THEN {_with_exponent(text)} ELSE {bind(_shortest(x), 'ss', sought)} END"
    )


def canonical_double(x: str) -> str:
    """Shortest text of a double: plain from 1e-4 up to 1e16, otherwise ``1.5e+16`` style."""
    text, size = "CAST(cd AS STRING)", "abs(cd)"
    sign = "CASE WHEN cd < 0 THEN '-' ELSE '' END"
    rare = (
        f"coalesce({_not_finite('cd')}, CASE WHEN {size} >= 1e16D OR {size} < 1e-4D "
        f"THEN concat({sign}, {bind(size, 'ca', _scientific('ca'))}) "
        f"WHEN {size} >= 1e7D THEN {_without_exponent(text, 10)} "
        f"ELSE {_without_exponent(text, 22)} END)"
    )
    return (
        f"CASE WHEN {x} = 0 OR (abs({x}) >= 1e-3D AND abs({x}) < 1e7D) THEN CAST({x} AS STRING) "
        f"ELSE {bind(x, 'cd', rare)} END"
    )


def looks_numeric(text: str) -> str:
    return f"({text} RLIKE {_NUMBER} OR {text} RLIKE {_SPECIAL})"


def parse_double(text: str) -> str:
    """Double from decimal text (``_`` between digits allowed); NULL for anything else."""
    return (
        f"CASE WHEN {text} RLIKE {_NUMBER} THEN try_cast(replace({text}, '_') AS DOUBLE) "
        f"WHEN {text} RLIKE {_SPECIAL} THEN try_cast(trim(lower({text})) AS DOUBLE) END"
    )


def _product_error(a: str, b: int, product: str) -> str:
    """Exact rounding error of ``a * b`` by splitting both factors in halves."""
    factor = float(b)
    b_high = _SPLITTER * factor - (_SPLITTER * factor - factor)
    b_low = factor - b_high
    spread = f"({a} * {_SPLITTER}D)"
    high = f"({spread} - ({spread} - {a}))"
    low = f"({a} - {high})"
    return (
        f"((({high} * {b_high!r}D - {product}) + {high} * {b_low!r}D + {low} * {b_high!r}D) "
        f"+ {low} * {b_low!r}D)"
    )


def _exact(x: str, places: int) -> str:
    """The general route: whole and fractional part apart, the fraction's product exact."""
    scale = 10**places
    odd = "fw % 2 = 1" if places == 0 else "fs.below % 2 = 1"
    text = "CAST(fw + (CASE WHEN fu >= {0} THEN 1 ELSE 0 END) AS STRING)".format(scale)
    if places:
        back = f"CAST(fu - (CASE WHEN fu >= {scale} THEN {scale} ELSE 0 END) AS STRING)"
        text = f"concat({text}, '.', lpad({back}, {places}, '0'))"
    units = f"fs.below + CASE WHEN fs.lean > 0 OR (fs.lean = 0 AND {odd}) THEN 1 ELSE 0 END"
    scaled = f"(fp * {scale}D)"
    split = (
        f"named_struct('below', floor({scaled}), 'lean', "
        f"({scaled} - CAST(floor({scaled}) AS DOUBLE) - 0.5D) + {_product_error('fp', scale, scaled)})"
    )
    part = f"CASE WHEN fm < {_TWO_53} THEN fm - CAST(fw AS DOUBLE) ELSE 0D END"
    rounded = bind(bind(bind(part, "fp", split), "fs", units), "fu", text)
    zeros = "." + "0" * places if places else ""
    whole_digits = f"concat(xd.digits, '{zeros}')"
    magnitude = (
        f"CASE WHEN fm < {_TWO_63} THEN {bind('floor(fm)', 'fw', rounded)} "
        f"ELSE {_exact_digits('fm', whole_digits)} END"
    )
    sign = f"CASE WHEN startswith(CAST({x} AS STRING), '-') THEN '-' ELSE '' END"
    return f"coalesce({_not_finite(x)}, concat({sign}, {bind(f'abs({x})', 'fm', magnitude)}))"


def _settled_tie(size: str, places: int) -> str:
    """Digits of a magnitude whose shortest text ends in the tie digit: the sign of the exact
    product's remainder tells whether the binary value lies above, below or on the tie."""
    scale = 10 ** (places + 1)
    product = f"({size} * {scale}D)"
    kept = f"floor(rint({product}) / 10)"
    lean = f"(({product} - rint({product})) + {_product_error(size, scale, product)})"
    up = f"CASE WHEN {lean} > 0 OR ({lean} = 0 AND {kept} % 2 = 1) THEN 1 ELSE 0 END"
    units = f"({kept} + {up})"
    if not places:
        return f"CAST({units} AS STRING)"
    step = format(Decimal(1).scaleb(-places), "f")
    return f"CAST(CAST({units} AS DECIMAL(18,0)) * {step}BD AS STRING)"


def fixed_point(x: str, places: int) -> str:
    """``%.{places}f`` of the exact binary value, ties to even (2.675 gives 2.67).

    A decimal cast rounds the shortest decimal text half up, which gives the same digits except
    where that text is itself a tie; ties are settled by exact arithmetic. Huge and non-finite
    values take a slower general route, and from 9e37 up keep the JVM formatter's digits.
    """
    if not 0 <= places <= 15:
        raise ValueError("decimal places must be between 0 and 15")
    size = f"abs({x})"
    text = (
        f"CASE WHEN {size} >= 1e-3D AND {size} < 1e7D THEN CAST({size} AS STRING) "
        f"WHEN {size} >= 1e7D THEN CAST(try_cast(CAST({size} AS STRING) AS DECIMAL(38,10)) AS STRING) "
        f"ELSE CAST(try_cast(CAST({size} AS STRING) AS DECIMAL(38,22)) AS STRING) END"
    )
    tie = literal(rf"^\d+\.\d{{{places}}}50*$")
    digits = (
        f"CASE WHEN ({text}) RLIKE {tie} THEN {_settled_tie(size, places)} "
        f"ELSE CAST(try_cast(({text}) AS DECIMAL(30,{places})) AS STRING) END"
    )
    sign = f"CASE WHEN startswith(CAST({x} AS STRING), '-') THEN '-' ELSE '' END"
    return (
        f"CASE WHEN {size} * {10 ** (places + 1)}D < {_TWO_53} THEN concat({sign}, {digits}) "
        f"WHEN {x} IS NOT NULL THEN {bind(x, 'fx', _exact('fx', places))} END"
    )


def short_decimal(text: str, places: int) -> tuple[str, str]:
    """Test for and rounding of plain decimals of up to 15 digits that are no tie; for these
    the text is the shortest form of its double, so no double is needed."""
    plain = literal(rf"^-?\d{{1,9}}(?:\.(?!\d{{{places}}}50*$)\d{{1,6}})?$")
    digits = f"CAST(try_cast(ltrim('-', {text}) AS DECIMAL(30,{places})) AS STRING)"
    sign = f"CASE WHEN startswith({text}, '-') THEN '-' ELSE '' END"
    return f"{text} RLIKE {plain}", f"concat({sign}, {digits})"


def fixed_point_integer(x: str, places: int) -> str:
    """Fixed-point text of an integer column; beyond 2^53 it rounds as a double would."""
    zeros = "." + "0" * places if places else ""
    rounded = bind(f"CAST({x} AS DOUBLE)", "fi", fixed_point("fi", places))
    return (
        f"CASE WHEN {x} BETWEEN -{2**53} AND {2**53} THEN concat(CAST({x} AS STRING), '{zeros}') "
        f"ELSE {rounded} END"
    )
