"""Column functions over text. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \t\r\n]+"

# Word pieces left by French elision, and the letters kept by normalisation.
ELISIONS = ("qu", "jusqu", "lorsqu", "puisqu", "quoiqu", "aujourd", "hui")
LETTERS = "a-zàâäçéèêëîïôöùûüÿñæœ"

CHARS_PER_TOKEN = 3.5
EXCERPT_WORDS = 180
#: Half-open bands of label frequency and their names.
BANDS = (("hapax", 1, 2), ("rare", 2, 10), ("medium", 10, 100), ("frequent", 100, 1_000_000_000))


def words(text: str | Column) -> Column:
    """Non-empty pieces between blanks; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.filter(F.split(c, BLANKS), lambda w: w != ""), F.array().cast("array<string>"))


def n_words(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def n_tokens(text: str | Column) -> Column:
    """The tokenizer-free estimate: one token per 3.5 characters, and one."""
    c = F.col(text) if isinstance(text, str) else text
    return (F.floor(F.coalesce(F.length(c), F.lit(0)) / F.lit(CHARS_PER_TOKEN)) + 1).cast("long")


def excerpt(text: str | Column, n: int = EXCERPT_WORDS) -> Column:
    """The first n words on one line, with a mark if the text goes on."""
    w = words(text)
    head = F.array_join(F.slice(w, 1, n), " ")
    return F.when(F.size(w) > n, F.concat(head, F.lit(" […]"))).otherwise(head)


def normalised(text: str | Column, stop: list[str] = (), phrases: list[str] = (), min_len: int = 2) -> Column:
    """Tokens of a text for topic models.

    Lower-case; phrases go as substrings, longest first; numbers become ``num``;
    all but LETTERS separates; short tokens, stop words and elisions go.
    """
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    for p in sorted((p.strip().lower() for p in phrases if p.strip()), key=len, reverse=True):
        c = F.replace(c, F.lit(p), F.lit(" "))
    c = F.regexp_replace(c, r"[0-9][0-9.,]*", " num ")
    # runs of letters are found, not cut out: a class of all but LETTERS tries each of them on every letter
    runs = F.regexp_extract_all(c, F.lit(f"[{LETTERS}]{{{max(min_len, 1)},}}"), F.lit(0))
    drop = [*stop, *ELISIONS]
    return F.coalesce(F.filter(runs, lambda w: ~w.isin(drop)), F.array().cast("array<string>"))


def class_words(text: str | Column, stop: list[str] = ()) -> Column:
    """Lower-case words of three letters or more, for the words of a class; stop words go."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.coalesce(F.filter(found, lambda w: ~w.isin(list(stop))) if stop else found, F.array().cast("array<string>"))


def truncated(text: str | Column, budget: int) -> Column:
    """Words kept so that the token estimate fits: cut to 80 % of the words until it does; 0 is no limit."""
    w = words(text)
    if budget <= 0:
        return F.size(w).cast("long")
    # one pass counts the words that fit; the cuts are then arithmetic
    size = lambda acc, x: acc["size"] + F.length(x) + 1
    fits = F.aggregate(
        w, F.struct(F.lit(-1).alias("size"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(size(acc, x).alias("size"), F.when(F.floor(size(acc, x) / CHARS_PER_TOKEN) + 1 <= budget, acc["n"] + 1).otherwise(acc["n"]).alias("n")),
        lambda acc: acc["n"],
    )
    # 80 % steps of any text shorter than 2**31 words end within 100 of them
    room = F.struct(F.size(w).alias("n"), F.greatest(fits, F.lit(1)).alias("fits"))
    cut = lambda acc: F.when(acc["n"] > acc["fits"], F.greatest(F.floor(acc["n"] * 0.8).cast("int"), F.lit(1))).otherwise(acc["n"])
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(100)), room, lambda acc, _: F.struct(cut(acc).alias("n"), acc["fits"].alias("fits")), lambda acc: acc["n"])
    return steps.cast("long")


def code_of(qcode: str | Column) -> Column:
    """What follows the first colon; the whole if there is none."""
    c = F.col(qcode) if isinstance(qcode, str) else qcode
    return F.when(F.instr(c, ":") > 0, F.regexp_extract(c, "^[^:]*:(.*)$", 1)).otherwise(c)


def label_of(labels: str, code: str | None = None, overrides: dict[str, str] | None = None) -> Column:
    """An override, the French label, the British one, the first of any, or ''; empty ones are passed over."""
    m = F.col(labels)
    own = F.lit(None).cast("string")
    if overrides and code:
        own = F.element_at(F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)), F.col(code))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(own), some(F.try_element_at(m, F.lit("fr"))), some(F.try_element_at(m, F.lit("en-GB"))), F.get(F.map_values(m), F.lit(0)), F.lit(""))


def band(n: str | Column) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    out = F.lit("hapax")
    for name, low, high in BANDS:
        out = F.when((c >= low) & (c < high), name).otherwise(out)
    return out


def is_noise(top_words: Column, first: int = 10, short: int = 2, at_least: int = 5) -> Column:
    """A topic is debris if five of its first ten words have two letters or fewer."""
    return F.size(F.filter(F.slice(top_words, 1, first), lambda w: F.length(w) <= short)) >= at_least


def shown_title(title: str | Column) -> Column:
    """Titles that are only an identifier (``DIV.12``) are not shown."""
    c = F.col(title) if isinstance(title, str) else title
    return F.when(c.rlike(r"^[A-Z]+\.[0-9]+$"), F.lit("")).otherwise(F.coalesce(c, F.lit("")))


def page_number(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.try_element_at(F.regexp_extract_all(c, F.lit("X0*([0-9]+)"), F.lit(1)), F.lit(1)).cast("int")


def year_of(date: str | Column) -> Column:
    """A publication year 18xx, 19xx or 20xx at the start of a date or of a range of dates."""
    c = F.col(date) if isinstance(date, str) else date
    return F.nullif(F.regexp_extract(F.trim(c), "^(18[0-9]{2}|19[0-9]{2}|20[0-9]{2})", 1), F.lit("")).cast("int")


def period(year: Column, start: int = 1800, width: int = 20) -> Column:
    first = (F.floor((year - start) / width) * width + start).cast("int")
    return F.concat(first.cast("string"), F.lit("-"), (first + width - 1).cast("string"))


def ark_of(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(c, r"(ark:/[0-9]+/[A-Za-z0-9]+)", 1), F.lit(""))


def image_url(base: str, ark: Column, page: Column, size: str = "full") -> Column:
    """Address of a page image under the public image interface."""
    return F.concat(F.lit(base.rstrip("/") + "/"), ark, F.lit("/f"), page.cast("string"), F.lit(f"/full/{size}/0/native.jpg"))
