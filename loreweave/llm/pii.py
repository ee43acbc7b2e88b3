"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

Candidates are found by one pattern, then validated (check digits, number ranges, calendar). A valid number or date is
read as a place in the set of all values of its format and permuted there by a keyed Feistel network over Z_A x Z_B, so the
pseudonym is again a valid value of the format, and equal values get equal pseudonyms in every document. Addresses and
keys are permuted character by character within letters and digits, by a Feistel network over the two halves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: What a candidate looks like, by kind; the first kind that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}\b",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .-])\d{3}[ .-]\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ymd": r"\b\d{4}[-/.]\d{2}[-/.]\d{2}\b",
    "mdy": r"\b\d{2}/\d{2}/\d{4}\b",
    "dmy": r"\b\d{2}\.\d{2}\.\d{4}\b",
    "card": r"\b\d(?:[ -]?\d){12,18}\b",
}
#: Ways to write a card: unbroken, in fours (and three more), 4-6-5, 4-6-4, 4-3-3-3, 4-4-5.
CARD_LAYOUT = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{3}\3\d{3}\3\d{3}|\d{4}([ -])\d{4}\4\d{5})$"
_NEXT = "(?!" + "|".join([*(PATTERNS[k] for k in ("email", "ipv4", "ssn", "ymd", "mdy", "dmy")), r"[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}\b"]) + ")"
#: Numbers of 13 digits or more in all, one blank or hyphen apart, up to where a value of another kind begins. Loops are possessive: Java recurses on others.
RUN = rf"\b(?=\d(?:(?:[ -]{_NEXT})?\d){{12}})\d++\b(?:[ -]{_NEXT}\d++\b)*+"
PATTERN = "|".join([p for k, p in PATTERNS.items() if k != "card"] + [RUN])
NEEDED = "[0-9@]|AKIA"  # every candidate holds one of these, so texts without any are not searched
EPOCH, DAYS = "1900-01-01", 270  # dates are permuted within blocks of 270 * 270 days from the epoch
FIRST_YEAR, LAST_YEAR = 1900, 2099


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _secret(key: str, kind: str, *parts: Column) -> Column:
    """A number under 2^52 from the key and the parts."""
    joined = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 13), 16, 10).cast("long")


def permute(value: Column, a: int | Column, b: int | Column, key: str, kind: str) -> Column:
    """Keyed permutation of 0 .. a * b - 1."""
    a, b = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    value = value.cast("long")
    pair = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    step = lambda s, i: F.when(
        i % 2 == 1, pair(F.pmod(s["x"] + _secret(key, kind, i, s["y"]), a), s["y"])
    ).otherwise(pair(s["x"], F.pmod(s["y"] + _secret(key, kind, i, s["x"]), b)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair(F.floor(value / b), value % b), step, lambda s: s["x"] * b + s["y"])


def _pad(value: Column, width: int | Column) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    place = lambda p: F.length(_digits(F.substring(shape, 1, p)))
    char = lambda p: F.substring(shape, p, 1)
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(shape)), lambda p: F.when(char(p).rlike("[0-9]"), F.substring(digits, place(p), 1)).otherwise(char(p))), ""
    )


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits in the Luhn way, the last digit at weight 1."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _text(value: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted within a-z, A-Z and 0-9; other characters and the order of classes stay."""
    half = F.floor(F.length(value) / 2).cast("int")

    def shift(own: Column, other: Column, i: Column) -> Column:
        def one(p: Column) -> Column:
            c = F.substring(own, p, 1)
            base = F.when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).when(c.rlike("[0-9]"), 48)
            size = F.when(c.rlike("[0-9]"), 10).otherwise(26)
            moved = F.pmod(F.ascii(c) - base + _secret(key, kind, i, p, F.lower(other)), size) + base
            return F.coalesce(F.char(moved), c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(own)), one), "")

    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    step = lambda s, i: F.when(i % 2 == 1, pair(shift(s["x"], s["y"], i), s["y"])).otherwise(pair(s["x"], shift(s["y"], s["x"], i)))
    start = pair(F.substring(value, 1, half), F.substring(value, half + 1, F.length(value)))
    mixed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda s: F.concat(s["x"], s["y"]))
    # A single character moves by a step that is never a whole turn.
    size = F.when(value.rlike("[0-9]"), 10).otherwise(26)
    base = F.when(value.rlike("[a-z]"), 97).when(value.rlike("[A-Z]"), 65).when(value.rlike("[0-9]"), 48)
    moved = F.char(F.pmod(F.ascii(value) - base + 1 + _secret(key, kind, F.lit("one")) % (size - 1), size) + base)
    return F.when(F.length(value) < 2, F.coalesce(moved, value)).otherwise(mixed)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    n = F.length(d)
    low = F.floor((n - 2) / 2)
    power = lambda e: F.pow(F.lit(10.0), e).cast("long")
    body = permute(F.substring(d, 2, n - 2), power(low), power(n - 2 - low), key, "card")
    open_ = F.concat(F.substring(d, 1, 1), _pad(body, n - 2))
    check = F.pmod(-_luhn(F.concat(open_, F.lit("0"))), F.lit(10)).cast("string")
    return _luhn(d) % 10 == 0, _refill(m, F.concat(open_, check))


def _pieces(gap: Column, m: Column) -> Column:
    """Array of gap and candidate; a run of numbers is cut into its cards and what is left between them.

    A card is a layout with right check digit, of overlapping ones the first, or else the whole of what no layout takes.
    """
    numbers = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))
    piece = lambda t: F.struct(F.regexp_extract(t, "^[ -]?", 0).alias("gap"), F.regexp_replace(t, "^[ -]", "").alias("m"))

    def end(rest: Column) -> Column:
        """How many numbers of ``rest`` make a card, 0 if none do."""
        text = lambda n: F.regexp_replace(F.array_join(F.slice(rest, F.lit(1), n), ""), "^[ -]", "")
        right = F.filter(
            F.sequence(F.lit(1), F.least(F.size(rest), F.lit(5))), lambda n: F.when(text(n).rlike(CARD_LAYOUT), _luhn(_digits(text(n))) % 10 == 0).otherwise(False)
        )
        return F.coalesce(F.try_element_at(right, F.lit(1)), F.lit(0))

    state = lambda done, left, skip: F.struct(done.alias("done"), left.alias("left"), skip.cast("int").alias("skip"))
    flush = lambda s: F.when(s["left"] == "", s["done"]).otherwise(F.array_append(s["done"], s["left"]))

    def step(s: Column, i: Column, numbers: Column) -> Column:
        rest = F.slice(numbers, i, 5)
        n = end(rest)
        card = F.array_append(flush(s), F.array_join(F.slice(rest, F.lit(1), n), ""))
        return (
            F.when(s["skip"] > 0, state(s["done"], s["left"], s["skip"] - 1))
            .when(n > 0, state(card, F.lit(""), n - 1))
            .otherwise(state(s["done"], F.concat(s["left"], F.element_at(numbers, i)), F.lit(0)))
        )

    empty = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    scan = lambda ns: F.aggregate(F.sequence(F.lit(1), F.size(ns)), empty, lambda s, i: step(s, i, ns), flush)
    cut = F.element_at(F.transform(F.array(numbers), scan), 1)  # bound by a lambda, so that the numbers are taken apart once
    parts = F.transform(cut, lambda t, i: F.struct(F.when(i == 0, gap).otherwise(piece(t)["gap"]).alias("gap"), piece(t)["m"].alias("m")))
    whole = F.array(F.struct(gap.alias("gap"), m.alias("m")))
    return F.when((F.length(m) > 13) & m.rlike("^[0-9][0-9 -]+$") & m.rlike("[ -]"), parts).otherwise(whole)


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    """American numbers are permuted within those of area and exchange from 200, within area codes under 200, and within the rest. An
    area code under 200 needs a country code or brackets: bare groups like 123-555-1234 are no phone."""
    d = _digits(m)
    head, last = F.substring(d, 1, F.length(d) - 10), F.substring(d, -10, 10)
    area, office, line = (F.substring(last, *p).cast("long") for p in ((1, 3), (4, 3), (7, 4)))
    new = permute(((area - 200) * 800 + (office - 200)) * 10_000 + line, 80_000, 80_000, key, "phone")
    north = F.concat((F.floor(new / 8_000_000) + 200).cast("string"), (F.floor(new / 10_000) % 800 + 200).cast("string"), _pad(new % 10_000, 4))
    low_area = _pad(permute(last, 40_000, 50_000, key, "phone area"), 10)
    new = permute(((area - 200) * 200 + office) * 10_000 + line, 40_000, 40_000, key, "phone office")
    low_office = F.concat((F.floor(new / 2_000_000) + 200).cast("string"), _pad(F.floor(new / 10_000) % 200, 3), _pad(new % 10_000, 4))
    american = F.when(area < 200, low_area).when(office < 200, low_office).otherwise(north)
    other = _pad(permute(last, 100_000, 100_000, key, "phone10"), 10)
    marked = m.rlike(r"^\+|\(")
    return marked | (area >= 200), _refill(m, F.concat(head, F.when(head.isin("", "1"), american).otherwise(other)))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, *p).cast("long") for p in ((1, 3), (5, 2), (8, 4)))
    place = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    new = permute(place, 898 * 99, 9999, key, "ssn")
    index = F.floor(new / (99 * 9999))
    text = F.concat_ws(
        "-", _pad(index + 1 + F.when(index >= 665, 1).otherwise(0), 3), _pad(F.floor(new / 9999) % 99 + 1, 2), _pad(new % 9999 + 1, 4)
    )
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), text


def _ipv4(m: Column, key: str) -> tuple[Column, Column]:
    octet = [F.split(m, r"\.").getItem(i).cast("long") for i in range(4)]
    new = permute(reduce(lambda v, o: v * 256 + o, octet), 65_536, 65_536, key, "ipv4")
    text = F.concat_ws(".", *[(F.floor(new / 256**i) % 256).cast("string") for i in (3, 2, 1, 0)])
    return reduce(lambda x, y: x & y, [o <= 255 for o in octet]), text


def _date(m: Column, order: str, key: str) -> tuple[Column, Column]:
    """With slashes the day comes first where month first is no date, and then in the pseudonym too."""
    d = _digits(m)
    at = {"ymd": ((1, 4), (5, 2), (7, 2)), "mdy": ((5, 4), (1, 2), (3, 2)), "dmy": ((5, 4), (3, 2), (1, 2))}[order]
    year, month, day = (F.substring(d, *p) for p in at)
    read = lambda x, y: F.try_to_date(F.concat_ws("-", year, x, y), "yyyy-MM-dd")
    date = first = read(month, day)
    if order == "mdy":
        date = F.coalesce(first, read(day, month))
    days = F.datediff(date, F.lit(EPOCH).cast("date")).cast("long")
    block = F.floor(days / (DAYS * DAYS))
    new = F.date_add(F.lit(EPOCH).cast("date"), (block * DAYS * DAYS + permute(days % (DAYS * DAYS), DAYS, DAYS, key, "date")).cast("int"))
    form = {"ymd": "yyyyMMdd", "mdy": "MMddyyyy", "dmy": "ddMMyyyy"}
    digits = F.date_format(new, form[order])
    if order == "mdy":
        digits = F.when(first.isNotNull(), digits).otherwise(F.date_format(new, form["dmy"]))
    return date.isNotNull() & year.cast("int").between(FIRST_YEAR, LAST_YEAR), _refill(m, digits)


def _email(m: Column, key: str) -> tuple[Column, Column]:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, 1, F.length(domain) - F.length(top) - 1)
    return F.lit(True), F.concat(_text(local, key, "local"), F.lit("@"), _text(host, key, "host"), F.lit("."), top)


def _key(m: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), F.concat(F.lit("AKIA"), _text(F.substring(m, 5, 16), key, "key"))


def _pseudonym(m: Column, key: str) -> Column:
    """Struct of kind and pseudonym of a candidate; a null kind and the candidate itself where it isn't valid or its pseudonym is itself."""
    makers = {
        "email": _email(m, key), "key": _key(m, key), "ipv4": _ipv4(m, key), "phone": _phone(m, key), "ssn": _ssn(m, key),
        "ymd": _date(m, "ymd", key), "mdy": _date(m, "mdy", key), "dmy": _date(m, "dmy", key), "card": _card(m, key),
    }
    rest = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind, (valid, text) in reversed(makers.items()):
        name = "date" if kind in ("ymd", "mdy", "dmy") else kind
        found = F.struct(F.when(text != m, name).alias("kind"), text.alias("text"))
        rest = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(F.coalesce(valid, F.lit(False)), found).otherwise(
            F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))).otherwise(rest)
    return rest


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, text with pseudonyms, spans, n_found, and the columns ``keep``.

    ``spans`` lists the candidates in order, numbers beside a card too: kind (null if not valid and left alone), ``skip`` (characters since the end
    of the one before), and ``length`` in the text given. Null texts give null and no spans; texts without candidates come back as
    they are. Null ids and repeated rows stay, an empty table gives none, and other columns are ignored whatever their
    names. The same key gives the same pseudonyms everywhere; keep it secret, as it undoes them.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    text = F.col("_text")
    searched = F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)))
    cut = rows.withColumn("_found", F.coalesce(searched, F.array().cast("array<string>")))
    cut = cut.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, PATTERN, -1)))
    found = F.flatten(F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), "_found", _pieces))
    cut = cut.withColumn("_pieces", F.when(F.size("_found") > 0, found))
    made = cut.withColumn("_new", F.transform("_pieces", lambda p: _pseudonym(p["m"], key)))
    n = F.size("_found")
    body = F.zip_with("_pieces", "_new", lambda p, r: F.concat(p["gap"], r["text"]))
    new_text = F.when(n > 0, F.concat(F.array_join(body, ""), F.element_at("_gaps", -1))).otherwise(text)
    measured = F.zip_with("_pieces", "_new", lambda p, r: F.struct(r["kind"].alias("kind"), F.length(p["gap"]).alias("skip"), F.length(p["m"]).alias("length")))
    empty = F.array().cast("array<struct<kind:string,skip:int,length:int>>")
    done = made.withColumn("spans", F.when(n > 0, measured).otherwise(empty))
    return done.select(
        F.col("_id").alias(id_col), new_text.alias(text_col), "spans",
        F.size(F.filter("spans", lambda s: s["kind"].isNotNull())).alias("n_found"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep if c not in (id_col, text_col)],
    )
