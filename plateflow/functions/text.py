"""Column expressions over plate texts; nulls count as empty. Those with `let` in them leave code generation."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plateflow.plans.dims import RULES

# A whole plate, and the beginning of one.
EXACT, PARTIAL = "^[A-Z]{1,4}[0-9]{1,4}[A-Z]?$", "^[A-Z]{1,4}[0-9]{1,4}"
# The letter that a digit is read for, and the digit that a letter is read for.
LETTERS_FOR, DIGITS_FOR = ("0125678", "OIZSGTB"), ("OQDUILTZSGB", "00001112568")
# Characters that look alike.
ALIKE = ("ILT1", "MNW", "UV", "BQ8", "S5", "OQD0", "Z2", "G6")
#: Length that a plate is expected to have.
EXPECTED = (4, 8)
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


#: A text's shape: a struct, or a dict of its columns.
Shape = Column | dict[str, Column]


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row. Spark evaluates what stands in body node by node, without code generation: what
    is long, or made for many rows, is better laid in columns (see `rerank.with_final_score`)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def apart(value: Column, by: Column) -> Column:
    """value, in a projection that Spark compiles outside whole-stage code: a lambda in it has that effect. There it falls into short
    methods, while a long projection within whole-stage code is one method beyond what the JVM compiles, and runs interpreted. The
    lambda is never called, since its array is null for every by (any text of the row): what stands below a lambda is evaluated node
    by node, so value stays outside."""
    return F.when(F.exists(F.when(F.length(by) < 0, F.array(F.lit(""))), lambda x: x == "").isNull(), value)


def norm(text: Column) -> Column:
    """Strips everything outside A-Z and 0-9. Upper-casing comes after that in the reference, so lower-case letters go and nothing is
    left to be raised."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.rlike(r"^[A-Z0-9]*\z"), whole).otherwise(F.regexp_replace(whole, "[^A-Z0-9]", ""))


def letters(t: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(t, "[^A-Z]", ""))


def shape_parts(t: Column) -> dict[str, Column]:
    """The parts of `shape`, as columns of their own."""
    tail = F.ltrim(t, F.lit(LETTERS))
    rest = F.ltrim(tail, F.lit(DIGITS))
    s = F.when(rest == "", 0).otherwise(letters(rest))  # most texts end here
    return {"p": F.length(t) - F.length(tail), "d": F.length(tail) - F.length(rest), "s": s, "ordered": F.length(rest) == s}


def shape(t: Column) -> Column:
    """struct(p, d, s, ordered): leading letters, digits after them, letters in the rest, and whether that is all."""
    return F.struct(*(v.alias(k) for k, v in shape_parts(t).items()))


def _rule(k: int, t: Column) -> Column:
    _, _, matcher, token, _ = RULES[k]
    return t.rlike(token) if matcher == "pattern" else t.startswith(token)


def _begins(k: int) -> str:
    """The characters that a text of the k-th rule may begin with; all, if that does not show."""
    _, _, matcher, token, _ = RULES[k]
    if matcher == "prefix":
        return token[0]
    found = re.match(r"\^(\[[A-Z0-9-]+\]|[A-Z0-9])(?![?*|]|\{0|\{,)", token)
    return "".join(x for x in LETTERS + DIGITS if re.match(found[1], x)) if found else LETTERS + DIGITS


#: The rules from this one on are single letters that a text begins with.
_SINGLE = next(k for k in range(len(RULES) + 1) if all(r[2] == "prefix" and len(r[3]) == 1 for r in RULES[k:]))


def rule_number(t: Column) -> Column:
    """Number of the first rule by priority that matches, or null. RULES is in that order: rules of one letter are the letter's place
    among them, and a pattern is looked for in texts that begin as it does."""
    first, out = F.substring(t, 1, 1), F.when(t == "", F.lit(None).cast("int"))
    for k in range(_SINGLE):
        begins = _begins(k)
        out = out.when(_rule(k, t) if RULES[k][2] == "prefix" or begins == LETTERS + DIGITS else (F.instr(F.lit(begins), first) > 0) & _rule(k, t), k)
    place = F.instr(F.lit("".join(r[3] for r in RULES[_SINGLE:])), first)
    return out.otherwise(F.when(place > 0, place + (_SINGLE - 1)))


def _of_rule(number: Column, place: int, otherwise) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(r[place]) for r in RULES)), number), F.lit(otherwise))


def identify_state(t: Column) -> Column:
    """struct(name, category, matched, priority) for a normalised text."""
    return let(rule_number(t), lambda n: F.struct(_of_rule(n, 0, "Unknown").alias("name"), _of_rule(n, 1, "Unknown").alias("category"), n.isNotNull().alias("matched"), _of_rule(n, 4, 0).alias("priority")))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def exact(s: Shape) -> Column:
    """Whether a normalised text matches EXACT, by its shape."""
    return s["ordered"] & s["p"].between(1, 4) & s["d"].between(1, 4) & (s["s"] <= 1)


def partial(s: Shape) -> Column:
    """Whether a normalised text matches PARTIAL, by its shape."""
    return s["p"].between(1, 4) & (s["d"] >= 1)


def regex_score(t: Column, known: Shape | None = None) -> Column:
    """known: the text's shape, if there is one already."""
    prefix = F.lit(False)
    for *_, token, _ in RULES:
        prefix = prefix | t.startswith(token)
    whole, begun = (t.rlike(EXACT), t.rlike(PARTIAL)) if known is None else (exact(known), partial(known))
    return F.when(t == "", 0.0).when(whole, 1.0).when(begun, 0.6).when(prefix, 0.4).otherwise(0.05)


def regex_label(t: Column, score: Column | None = None) -> Column:
    score = regex_score(t) if score is None else score
    return F.when(score == 1.0, "exact").when(score == 0.6, "partial").when(score == 0.4, "prefix").otherwise("none")


def structure_label(t: Column, known: Shape | None = None) -> Column:
    said = lambda s: F.concat(F.lit("P"), s["p"].cast("string"), F.lit("-D"), s["d"].cast("string"), F.lit("-S"), s["s"].cast("string"))
    return F.when(t == "", "empty").otherwise(said(shape_parts(t) if known is None else known))


def length_label(t: Column) -> Column:
    return F.when(t == "", "empty").when(F.length(t).between(*EXPECTED), "expected").otherwise("out_of_range")


def composition_score(t: Column, a: Column | None = None) -> Column:
    """a: the text's letters, if they are counted already."""
    a, n = letters(t) if a is None else a, F.length(t)
    d = n - a
    x = F.when(t == "", 0.0).when(a.between(1, 4) & d.between(3, 4) & n.between(5, 8), 1.0).when((a >= 1) & (d >= 1), 0.55).when(d == 0, 0.15).otherwise(0.10)
    return x * F.when(n.between(*EXPECTED), 1.0).otherwise(0.75)


def length_score(t: Column) -> Column:
    n = F.length(t)
    far = F.abs(n - F.lit(6.5))
    return F.when(n == 0, 0.0).when(n.between(*EXPECTED), F.greatest(F.lit(0.35), 1 - 0.22 * far)).otherwise(F.greatest(F.lit(0.0), 0.55 - 0.18 * far))


def leading_zero(t: Column, s: Column) -> Column:
    return s["ordered"] & (s["d"] >= 2) & (F.substring(t, s["p"] + 1, F.lit(1)) == "0")


def structure_score(t: Column, known: Shape | None = None) -> Column:
    """known: the text's shape, if there is one already."""

    def of(s: Shape) -> Column:
        p, d = s["p"], s["d"]
        prefix = F.when(p == 0, 0.0).when(p == 1, 0.42).when(p == 2, 0.75).when(p == 3, 1.0).when(p == 4, 0.88).otherwise(F.greatest(F.lit(0.15), 0.80 - 0.12 * F.abs(p - 3)))
        digit = F.when(d == 0, 0.0).when(d == 1, 0.20).when(d == 2, 0.35).when(d == 3, 0.82).when(d == 4, 1.0).otherwise(F.greatest(F.lit(0.15), 0.85 - 0.15 * F.abs(d - 4)))
        suffix = F.when(s["s"] == 0, 1.0).when(s["s"] == 1, 0.9).otherwise(0.05)
        total = 0.42 * prefix + 0.28 * digit + 0.12 * suffix + F.when(s["ordered"], 0.10).otherwise(0.0) + 0.08 * clamp(F.length(t) / 4.0)
        return F.when(t == "", 0.0).otherwise(clamp(total - F.when(leading_zero(t, s), 0.35).otherwise(0.0)))

    return let(shape(t), of) if known is None else of(known)


def prefix_plausibility(t: Column, number: Column | None = None) -> Column:
    """The class between a matched rule and none is unreachable: a known lead letter is itself a matching rule. number: of the text's
    rule, if it is known."""
    return F.when(t == "", 0.0).when((rule_number(t) if number is None else number).isNotNull(), 1.0).otherwise(0.05)


def rule_priority(number: Column) -> Column:
    """The priority of a rule by its number."""
    return _of_rule(number, 4, 0)


def state_name(number: Column) -> Column:
    """The name of a rule by its number."""
    return _of_rule(number, 0, "Unknown")


def as_letters(t: Column) -> Column:
    return F.translate(t, *LETTERS_FOR)


def as_digits(t: Column) -> Column:
    return F.translate(t, *DIGITS_FOR)


#: Places up to which edits are counted in generated code; longer texts are counted in a fold.
PLACES = 12


def edit_count(a: Column, b: Column) -> Column:
    """Places that differ, and the difference in length."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    folded = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))) + F.abs(F.length(a) - F.length(b))
    # A place behind the shorter text's end differs from it.
    each = [(F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(1, PLACES + 1)]
    return F.when(F.greatest(F.length(a), F.length(b)) <= PLACES, sum(each[1:], each[0])).otherwise(folded)


def visual_similarity(a: Column, b: Column) -> Column:
    """Equal characters count 1, similar ones .6, others -.2, missing ones -.35, over the longer length; within 0 and 1."""
    n, m = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))

    def one(i: Column) -> Column:
        x, y = F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1))
        alike = F.lit(False)
        for group in ALIKE:
            alike = alike | (F.lit(group).contains(x) & F.lit(group).contains(y))
        return F.when(x == y, 1.0).when(alike, 0.6).otherwise(-0.2)

    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(places, F.lit(0.0), lambda acc, i: acc + one(i)) - 0.35 * (m - n)
    return F.when(m == 0, 0.0).otherwise(clamp(total / m))


def _distinct(values: list[Column]) -> Column:
    """The distinct values that are not null, as an array; without a lambda."""
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def readings(t: Column, letters_of: Column, digits_of: Column) -> Column:
    """Distinct readings of a text: itself, and each split into 1-4 letters, 1-4 digits and at most one letter, with each region mapped
    to its kind. letters_of, digits_of: `as_letters` and `as_digits` of it, best as columns, since every split reads them. A text has
    the splits of its length only, eight at most."""

    def split(p: int, d: int, s: int) -> Column:
        return F.concat(F.substring(letters_of, 1, p), F.substring(digits_of, p + 1, d), *([F.substring(letters_of, p + d + 1, s)] if s else []))

    out, n = F.when(t.isNotNull(), F.array(t)).otherwise(F.array().cast("array<string>")), F.length(t)
    for k in range(2, 10):
        out = F.when(n == k, F.array_distinct(F.array(t, *(split(p, k - p - s, s) for p in range(1, 5) for s in (0, 1) if 1 <= k - p - s <= 4)))).otherwise(out)
    return out


#: What a rule adds to `repair_score` at most, and the lengths by which that judges a text.
_RULE, _LENGTH = 0.14, 0.24
#: What pattern and form add at most to the score of a text that is no whole plate: half a pattern, a form without what it lacks.
_LOOSE = 0.42 * 0.55 + 0.20 * 0.92


def _form_most(p: int, d: int, s: int) -> float:
    """What pattern and form add at most to the score of a whole plate: `_form` of it, without what is taken off."""
    return 0.42 + 0.20 * (0.22 + 0.16 + 0.16 + 0.08 + 0.20 * (2 <= p <= 3) + 0.18 * (3 <= d <= 4) + 0.08 * (s == 0))


def _rule_most(letter: str) -> float:
    """What a rule adds at most to the score of a reading of a text that begins with a letter or digit; a reading begins as the text
    does, or with the letter for that."""
    starts = {letter, letter.translate(str.maketrans(*LETTERS_FOR))}
    return max((_RULE * min(1.0, r[4] / 100) + (0.0 if len(r[3]) < 2 else 0.22 if r[4] >= 90 else 0.18) for k, r in enumerate(RULES) if starts & set(_begins(k))), default=0.0)


def _base(t: Column) -> Column:
    """What rule and length add at most to the score of a reading of t, with the rule's bonus."""
    by = {}
    for letter in LETTERS + DIGITS:
        by[_rule_most(letter)] = by.get(_rule_most(letter), "") + letter
    first, most = F.substring(t, 1, 1), F.lit(max(by))
    for value in sorted(by, reverse=True):
        most = F.when(F.instr(F.lit(by[value]), first) > 0, value).otherwise(most)
    return most + _LENGTH * F.greatest(F.lit(0.0), 1 - 0.18 * F.abs(F.length(t) - 7)) + 1e-9


def room(t: Column, least: Column) -> Column:
    """What pattern and form of a reading of t have to add for its score, with its rule's bonus and without the costs of its edits, to
    be over least. Nearly; never more."""
    return least - _base(t)


def most(t: Column) -> Column:
    """A bound on `repair_score`, with the rule's bonus, for all readings of t and its `rule_candidates`: no bound, if it may have any."""
    alike = F.lit(False)
    for _, _, matcher, token, _ in RULES:
        if matcher == "prefix" and len(token) > 1:
            alike = alike | t.rlike(_may_be_like(token))
    # A last character that stands for no digit is a letter behind the plate, or the plate is none.
    end = F.instr(F.lit(DIGITS + DIGITS_FOR[0]), F.substring(t, F.length(t), F.lit(1))) > 0
    return F.when(alike, float("inf")).otherwise(_base(t) + F.when(end, _form_most(3, 4, 0)).otherwise(_form_most(3, 4, 1)))


def split_limits(t: Column, room: Column) -> dict[str, Column]:
    """What tells which splits of t (see `readings`) are whole plates: how many characters from its beginning stand for letters
    (lead), how many before its end for digits (tail), how many before its last one (tail1, where that stands for a letter). Null for
    texts that no split of is worth anything."""
    above, below, n = LETTERS + LETTERS_FOR[0], DIGITS + DIGITS_FOR[0], F.length(t)
    able = (room < _form_most(3, 4, 0)) & n.between(2, 9)
    before = F.substring(t, F.lit(1), n - 1)
    ends = lambda x: F.length(x) - F.length(F.rtrim(x, F.lit(below)))
    return {"lead": F.when(able, n - F.length(F.ltrim(t, F.lit(above)))), "tail": F.when(able, ends(t)), "tail1": F.when(able & (room < _form_most(3, 4, 1)) & (F.instr(F.lit(above), F.substring(t, n, F.lit(1))) > 0), ends(before))}


def worth(t: Column, room: Column, limits: dict[str, Column]) -> dict[tuple[int, int], Column]:
    """By how many letters and how many letters at the end: whether that split of t is worth scoring, as it may be over what `room`
    was made for. A split that is a whole plate is one that t's limits allow, so the others score as loose texts do."""
    n, out = F.length(t), {}
    for p in range(1, 5):
        for s in (0, 1):
            d, able = n - (p + s), F.lit(False)
            for k in range(1, 5):
                able = F.when(d == k, room < _form_most(p, k, s)).otherwise(able)
            out[p, s] = F.coalesce(able & (limits["lead"] >= p) & (d <= limits["tail1" if s else "tail"]), F.lit(False))
    return out


def any_promising(room: Column, able: dict[tuple[int, int], Column]) -> Column:
    """Whether `promising` reads anything."""
    some = room < _LOOSE
    for v in able.values():
        some = some | v
    return some


def promising(t: Column, letters_of: Column, digits_of: Column, room: Column, able: dict[tuple[int, int], Column]) -> Column:
    """Those `readings` of t that may be over what `room` was made for; others may be among them."""
    n = F.length(t)
    split = lambda p, s: F.concat(F.substring(letters_of, 1, p), F.substring(digits_of, F.lit(p + 1), n - (p + s)), *([F.substring(letters_of, n, F.lit(1))] if s else []))
    found = F.when(any_promising(room, able), _distinct([F.when(v, split(*k)) for k, v in able.items()]))
    return F.when(room < _LOOSE, readings(t, letters_of, digits_of)).otherwise(F.coalesce(found, F.array().cast("array<string>")))


def repair_candidates(t: Column) -> Column:
    """`readings` of a text, sorted."""
    return F.sort_array(readings(t, as_letters(t), as_digits(t)))


def canonical(t: Column, suffix: bool = True) -> Column:
    """A normalised text; without the letter after a whole plate where plates have none (suffix False)."""
    return t if suffix else F.regexp_replace(t, "^([A-Z]{1,4}[0-9]{1,4})[A-Z]$", "$1")


def pattern_label(t: Column) -> Column:
    """L<letters before the first digit>-D<first run of digits>-S<all the rest>, or unparsed if letters or digits are not 1 to 4."""
    p = F.length(F.regexp_replace(F.regexp_extract(t, "^([^0-9]*)", 1), "[^A-Z]", ""))
    d = F.length(F.regexp_extract(t, "([0-9]+)", 1))
    return F.when(t == "", "").when(p.between(1, 4) & d.between(1, 4), F.format_string("L%d-D%d-S%d", p, d, F.length(t) - p - d)).otherwise("unparsed")


def best_prefix_similarity(letters: Column, token: str) -> Column:
    """The likeness of the part of letters that looks most like token; of all of letters, if they are fewer."""
    n = len(token)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters) - n + 1, F.lit(1))), lambda i: visual_similarity(F.substring(letters, i, F.lit(n)), F.lit(token)))
    return F.when(letters == "", 0.0).otherwise(F.array_max(windows))


#: Likeness from which a rule's token stands in for the letters of a text.
LIKE = 0.54


def _may_be_like(token: str) -> str:
    """A pattern that every text matches whose letters, or part of them, have the likeness LIKE to token; others may match too. Of m
    places, c of them neither equal nor alike, the likeness is at most (m - c - .2 c - .35 (n - m)) / n."""
    n = len(token)
    alike = ["[" + k + "".join(g for g in ALIKE if k in g) + "]" for k in token]
    found = []
    for m in range(1, n + 1):
        most = int((m - 0.35 * (n - m) - LIKE * n) / 1.2 + 1e-9) if m - 0.35 * (n - m) - LIKE * n > -1e-9 else -1
        for other in itertools.combinations(range(m), most) if most >= 0 else ():
            whole = "".join("." if i in other else alike[i] for i in range(m))
            found.append(whole if m == n else f"^{whole}")
    return "(?s)" + "|".join(found)


def rule_candidates(t: Column) -> Column:
    """Readings that take a rule's token of several letters for a text's letters, before its last 1 to 4 digits and letter."""
    tail = F.regexp_extract(t, "([0-9]{1,4}[A-Z]?)$", 1)
    letters_of = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
    tokens = [token for _, _, matcher, token, _ in RULES if matcher == "prefix" and len(token) > 1]
    # Most texts end at the pattern, in generated code; likeness itself is a fold.
    found = [F.when(t.rlike(_may_be_like(k)) & (tail != "") & (best_prefix_similarity(letters_of, k) >= LIKE), F.concat(F.lit(k), tail)) for k in tokens]
    return _distinct(found)


def prefix_bonus(number: Column) -> Column:
    """What a text gains by a rule (by its number) whose token has several characters, patterns included."""
    return F.when(F.length(_of_rule(number, 3, "")) > 1, F.when(_of_rule(number, 4, 0) >= 90, 0.22).otherwise(0.18)).otherwise(0.0)


def _form(t: Column, s: Column, o: Column) -> Column:
    """The form's part of repair_score. s, o: shapes of the text and of the one that it is a reading of."""
    p, d = s["p"], s["d"]
    w = lambda cond, x: F.when(cond, x).otherwise(0.0)
    form = w(s["ordered"], 0.22) + w(p.between(1, 4), 0.16) + w(d.between(1, 4), 0.16) + w(s["s"] <= 1, 0.08) + w(p.between(2, 3), 0.20) + w(d.between(3, 4), 0.18) + w(s["s"] == 0, 0.08)
    form = F.when(leading_zero(t, s), F.greatest(F.lit(0.0), form - 0.35)).otherwise(form)
    lost = o["ordered"] & (o["p"] >= 3) & (o["d"] > 0) & (o["d"] < 3) & (p < o["p"])
    return F.when(lost, F.greatest(F.lit(0.0), form - 0.18)).otherwise(form)


def repair_score(t: Column, s: Column, o: Column, number: Column) -> Column:
    """How much a text looks like a plate. s: its shape; o: that of the text that it is a reading of; number: of its rule. `room` and
    what it goes by are bounds of this."""
    regex = F.when(exact(s), 1.0).when(partial(s), 0.55).otherwise(0.0)
    priority = _of_rule(number, 4, 0)
    return 0.42 * regex + 0.24 * F.greatest(F.lit(0.0), 1 - 0.18 * F.abs(F.length(t) - 7)) + 0.20 * _form(t, s, o) + 0.14 * F.least(F.lit(1.0), priority / 100.0)


def least_gain(confidence: Column, layout: Column) -> Column:
    gain = F.when(confidence <= 0.84, F.greatest(F.lit(0.005), F.lit(0.03) - 0.015)).otherwise(0.03)
    return F.when(layout == "two_row", F.greatest(F.lit(0.005), gain - 0.010)).otherwise(gain)


def row_text(t: Column, row: Column, two_row: Column) -> Column:
    """A row's reading: of a plate of two rows letters above and digits below, each character as what it is read for."""
    above, below = F.regexp_replace(as_letters(t), "[^A-Z]", ""), F.regexp_replace(as_digits(t), "[^0-9]", "")
    return F.when(two_row, F.when(row == 1, above).otherwise(below)).otherwise(t)


def row_score(t: Column, confidence: Column, row: Column, two_row: Column) -> Column:
    """Score of a row's reading; -1 for an empty one."""
    n, letters, digits = F.length(t), F.length(F.regexp_replace(t, "[^A-Z]", "")), F.length(F.regexp_replace(t, "[^0-9]", ""))
    w = lambda cond, x: F.when(cond, x).otherwise(0.0)
    above = w(letters == n, 0.35) + w(n.between(1, 4), 0.16) - w(n > 4, 0.18) - w(digits > 0, 0.20)
    below = w(digits == n, 0.40) + w(n.between(1, 4), 0.24) - w(n > 4, 0.20) - w(letters > 0, 0.24)
    return F.when(t == "", -1.0).otherwise(confidence + F.when(two_row & (row == 1), above).when(two_row & (row == 2), below).otherwise(0.0))


def row_variant_bonus(name: Column, row: Column, two_row: Column) -> Column:
    kind = F.when((row == 1) & name.contains("letters"), 0.08).when((row != 1) & name.contains("digits"), 0.10).otherwise(0.0)
    made = F.when(name.contains("prepared"), 0.03).when(name.contains("binary"), 0.02).otherwise(0.0)
    return F.when(two_row, kind + made).otherwise(0.0)


# What a reading gains by source and layout, on plates of two rows and on others.
TWO_ROW_BONUS = {("row_composite", "Line"): 0.18, ("text_only", "Block"): 0.12, ("text_only", None): 0.05, ("full_plate", "Line"): -0.03}
ONE_ROW_BONUS = {("text_only", "Line"): 0.12, ("text_only", "Block"): 0.07, ("text_only_trimmed", "Line"): 0.11, ("text_only_trimmed", "Block"): 0.09, ("full_plate", "Line"): 0.03}


def variant_bonus(source: Column, layout: Column, two_row: Column, profile: Column | None = None) -> Column:
    """profile: what a row composite gains by it is added, if it is given."""

    def of(table: dict) -> Column:
        out = F.lit(0.0)
        for (name, kind), x in reversed(table.items()):
            out = F.when((source == name) & (F.lit(True) if kind is None else layout == kind), x).otherwise(out)
        return out

    own = F.when(two_row, of(TWO_ROW_BONUS)).otherwise(of(ONE_ROW_BONUS))
    return own if profile is None else own + F.when((profile == "two_row") & (source == "row_composite"), 0.05).otherwise(0.0)


def hint_layout(layout: Column, profile: Column) -> Column:
    """The layout that is known, else two_row by the profile, else unknown."""
    return F.when(F.coalesce(layout, F.lit("")) != "", layout).when(profile == "two_row", "two_row").otherwise("unknown")


def refined(t: Column, confidence: Column, suffix: bool = True) -> Column:
    """struct(text, label): a text with one letter cut from its end or its head where it looks more like a plate without it. A single
    letter behind the digits is doubted only where plates may have one (suffix)."""

    def state(x: Column) -> Column:
        return F.struct(x.alias("t"), refinement_score(x).alias("score"), identify_state(x)["priority"].alias("priority"), shape(x).alias("shape"))

    cut = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)

    def step(now: Column, label: Column) -> Column:
        return F.struct(now["t"].alias("t"), now["score"].alias("score"), now["priority"].alias("priority"), now["shape"].alias("shape"), label.alias("label"))

    def tail(a: Column) -> Column:
        shorter = let(state(cut(a["t"])), lambda b: F.when(b["score"] > a["score"] + 0.06, step(b, F.lit("trim_tail"))).otherwise(step(a, F.lit(""))))
        return F.when(a["shape"]["s"] > 1, shorter).otherwise(step(a, F.lit("")))

    def weak(a: Column) -> Column:
        plain = lambda b: b["t"].rlike("^[A-Z]{1,4}[0-9]{1,4}$") & (b["score"] >= a["score"] - 0.02)
        shorter = let(state(cut(a["t"])), lambda b: F.when(plain(b), step(b, F.lit("trim_weak_suffix"))).otherwise(a))
        return F.when((a["shape"]["s"] == 1) & (confidence <= 0.25), shorter).otherwise(a)

    def head(a: Column) -> Column:
        same = F.struct(a["t"].alias("text"), a["label"].alias("label"))

        def of(b: Column) -> Column:
            better = F.when(b["priority"] > a["priority"], b["score"] > a["score"] + 0.04).when(b["priority"] == a["priority"], b["score"] > a["score"] + 0.02).otherwise(False)
            return F.when(better, F.struct(b["t"].alias("text"), F.lit("trim_head").alias("label"))).otherwise(same)

        return F.when(a["shape"]["p"] >= 2, let(state(F.substring(a["t"], F.lit(2), F.length(a["t"]))), of)).otherwise(same)

    found = let(state(t), lambda x: let(tail(x), lambda y: let(weak(y), head) if suffix else head(y)))
    return F.when(t == "", F.struct(F.lit("").alias("text"), F.lit("").alias("label"))).otherwise(found)


def clamp_confidence(x: Column) -> Column:
    """Confidences within 0 and 1; percentages, if one of them is over 1."""
    by = F.when(F.array_max(x) > 1, 100.0).otherwise(1.0)
    return F.transform(x, lambda v: clamp(v / by))


def expanded_confidence(t: Column, own: Column, whole: Column) -> Column:
    """A confidence for each character: its own, if there are as many, else the text's."""
    return F.when(F.size(own) == F.length(t), F.transform(own, clamp)).otherwise(F.array_repeat(clamp(whole), F.length(t)))


def characters(t: Column) -> Column:
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def top_candidates(chars: Column, confidences: Column) -> Column:
    return F.arrays_zip(chars, confidences).cast("array<struct<label:string,score:double>>")


def attempt_score(t: Column, confidence: Column, known: Shape | None = None) -> Column:
    """Score of an OCR attempt; -1 for an empty text. known: the text's shape, if there is one already."""

    def of(s: Shape) -> Column:
        n, p, d = F.length(t), s["p"], s["d"]
        w = lambda cond, x: F.when(cond, x).otherwise(0.0)
        both = F.when((p > 0) & (d > 0), True).otherwise(t.rlike("[A-Z]") & t.rlike("[0-9]"))
        total = confidence + F.when(exact(s), 0.40).when(partial(s), 0.22).otherwise(0.0) + w(both, 0.18)
        total = total + w(s["ordered"], 0.12) + F.when(p.between(2, 3), 0.16).when(p == 1, 0.04).otherwise(0.0) + F.when(d.between(3, 4), 0.10).when(d >= 1, 0.03).otherwise(0.0) - 0.06 * s["s"]
        total = total + w((s["s"] == 0) & s["ordered"] & p.between(1, 4) & d.between(1, 4), 0.08) - 0.10 * F.abs(n - 7)
        total = total - w(n < 5, 0.18) - w((p <= 1) & (n <= 5), 0.16) - w((p == 0) & t.rlike("[0-9]"), 0.12) - w(leading_zero(t, s), 0.12)
        return F.when(t == "", -1.0).otherwise(total)

    return let(shape(t), of) if known is None else of(known)


def refinement_score(t: Column, known: Shape | None = None, number: Column | None = None) -> Column:
    """How much a text looks like a plate while its ends are trimmed: as repair_score, with even weights for its form. known, number:
    its shape and that of its rule, if they are there already."""

    def of(s: Shape) -> Column:
        w = lambda cond, x: F.when(cond, x).otherwise(0.0)
        form = w(s["ordered"], 0.30) + w(s["p"].between(1, 4), 0.25) + w(s["d"].between(1, 4), 0.25) + w(s["s"] <= 1, 0.20)
        form = F.when(leading_zero(t, s), F.greatest(F.lit(0.0), form - 0.35)).otherwise(form)
        regex = F.when(exact(s), 1.0).when(partial(s), 0.55).otherwise(0.0)
        priority = rule_priority(rule_number(t) if number is None else number)
        return 0.42 * regex + 0.24 * F.greatest(F.lit(0.0), 1 - 0.18 * F.abs(F.length(t) - 7)) + 0.20 * form + 0.14 * F.least(F.lit(1.0), priority / 100.0)

    return let(shape(t), of) if known is None else of(known)
