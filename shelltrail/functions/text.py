"""Column functions over command text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a command is
# trimmed or cut into fields.
WHITE_SPACE = " \t\n\v\f\r" + "".join(
    map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

# Limits of a typing correction.
MAX_LENGTH_DIFFERENCE = 5
MIN_EDITS, MAX_EDITS, BYTES_PER_EDIT = 2, 5, 10

# Longer commands (bytes) are compared by their diagonals: a distance matrix, even a band of one,
# costs the engine the square of their length.
LONG_COMMAND = 512


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` written and computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def trim_space(c: Column | str) -> Column:
    """Trim every Unicode space, not only the space character.

    Trimming a set of characters is slow, so text without any at its ends skips it.
    """

    def trim(x: Column) -> Column:
        padded = F.left(x, F.lit(1)).isin(*WHITE_SPACE) | F.right(x, F.lit(1)).isin(*WHITE_SPACE)
        return F.when(padded, F.btrim(x, F.lit(WHITE_SPACE))).otherwise(x)

    return bind(_col(c), trim)


def one_char_per_byte(c: Column) -> Column:
    """Text with one character per UTF-8 byte, so that character distances count bytes."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, c).otherwise(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"))


def longer_after(before: Column, now: Column, seconds: int) -> Column:
    """Whether more than ``seconds`` lie between two times, also if a long cannot hold them."""
    return F.coalesce(F.try_subtract(now, before) > seconds, now > before)


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance in bytes."""
    return F.levenshtein(one_char_per_byte(_col(a)), one_char_per_byte(_col(b)))


def within_max_edits(a: Column, b: Column) -> Column:
    """Whether two binaries, of lengths at most ``MAX_EDITS`` apart, are within ``MAX_EDITS`` edits.

    For e edits and every diagonal of the distance matrix the furthest place that e edits reach,
    from those of e - 1 edits: a few comparisons of long stretches, whatever the lengths.
    """
    k = MAX_EDITS
    far = F.lit(-1000)

    def equal_from(x: Column, y: Column, i: Column, j: Column) -> Column:
        """Equal bytes from places i and j on, by halving steps."""

        def longer(done: Column, bit: Column) -> Column:
            step = F.call_function("shiftleft", F.lit(1), bit)
            fits = (i + done + step <= F.octet_length(x)) & (j + done + step <= F.octet_length(y))
            same = F.substring(x, i + done + 1, step) == F.substring(y, j + done + 1, step)
            return F.when(fits & same, done + step).otherwise(done)

        return F.aggregate(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), F.lit(0), longer)

    def furthest(x: Column, y: Column) -> Column:
        def reached(i: Column, d: Column) -> Column:
            start = F.least(i, F.octet_length(x), F.octet_length(y) - d)
            ahead = equal_from(x, y, start, start + d)
            return F.when(start < F.greatest(F.lit(0), -d), far).otherwise(start + ahead)

        # diagonals -k - 1 to k + 1, the outer ones never reached
        first = F.transform(
            F.sequence(F.lit(-k - 1), F.lit(k + 1)),
            lambda d: F.when(d == 0, reached(F.lit(0), d)).otherwise(far),
        )

        def one_more(before: Column, _: Column) -> Column:
            def diagonal(d: Column) -> Column:
                at = d + k + 1
                best = F.greatest(F.get(before, at) + 1, F.get(before, at - 1), F.get(before, at + 1) + 1)
                return F.when(F.abs(d) > k, far).otherwise(bind(best, lambda i: reached(i, d)))

            return F.transform(F.sequence(F.lit(-k - 1), F.lit(k + 1)), diagonal)

        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), first, one_more)

    def reaches_end(x: Column, y: Column) -> Column:
        last = F.octet_length(y) - F.octet_length(x) + k + 1
        return F.get(furthest(x, y), last) == F.octet_length(x)

    return bind(a, lambda x: bind(b, lambda y: reaches_end(x, y)))


def is_typo(a: Column | str, b: Column | str) -> Column:
    """Whether ``b`` is a small edit of ``a`` (both trimmed); false on nulls.

    The length test comes first and the distance is bounded, so that long commands cost little.
    """
    a, b = _col(a), _col(b)
    size_a, size_b = F.octet_length(a), F.octet_length(b)
    allowed = F.least(
        F.greatest(F.floor(F.greatest(size_a, size_b) / BYTES_PER_EDIT), F.lit(MIN_EDITS)),
        F.lit(MAX_EDITS),
    )
    # -1 stands for "more than MAX_EDITS"
    edits = F.levenshtein(one_char_per_byte(a), one_char_per_byte(b), MAX_EDITS)
    near = F.abs(size_a - size_b) <= MAX_LENGTH_DIFFERENCE
    # long commands are allowed all MAX_EDITS
    long = (a != b) & within_max_edits(a.cast("binary"), b.cast("binary"))
    return (
        F.when(near & (F.least(size_a, size_b) > LONG_COMMAND), long)
        .when(near, (edits > 0) & (edits <= allowed))
        .otherwise(F.lit(False))
    )


def export_variable(c: Column | str) -> Column:
    """Variable name of an ``export NAME=value`` command (trimmed), else null."""
    c = _col(c)
    name = F.btrim(F.substring_index(c.substr(F.lit(8), F.length(c)), "=", 1), F.lit(WHITE_SPACE))
    return F.when(c.startswith("export "), name)


def is_superseded(a: Column | str, b: Column | str) -> Column:
    """Whether ``b`` makes ``a`` pointless: two ``cd``, or two ``export`` of one variable."""
    a, b = _col(a), _col(b)
    moves = a.startswith("cd ") & b.startswith("cd ")
    var_a, var_b = export_variable(a), export_variable(b)
    same_variable = F.coalesce((var_a != "") & (var_a == var_b), F.lit(False))
    return F.coalesce(moves, F.lit(False)) | same_variable


def leading_tool(c: Column | str, wrappers: tuple[str, ...]) -> Column:
    """First white-space separated field, or the second one behind a wrapper if there is one."""

    def choose(plain: Column) -> Column:
        first = F.substring_index(plain, " ", 1)
        rest = F.ltrim(plain.substr(F.length(first) + 1, F.length(plain)))
        second = F.substring_index(rest, " ", 1)
        return F.when(first.isin(*wrappers) & (second != ""), second).otherwise(first)

    plain = F.btrim(F.translate(_col(c), WHITE_SPACE, " " * len(WHITE_SPACE)))
    return bind(plain, choose)


def step_tool(c: Column | str) -> Column:
    """Tool that decides where a step ends."""
    return leading_tool(c, ("sudo", "time", "nice", "nohup"))


def required_tool(c: Column | str) -> Column:
    """Tool whose installation is a prerequisite (only ``sudo`` is looked through)."""
    return leading_tool(c, ("sudo",))
