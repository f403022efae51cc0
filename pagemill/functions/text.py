"""Column functions over text: every one is a built-in expression, so it stays in whole-stage code.

"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading letters that stand for a Latin option letter.
LOOKALIKE_FROM = "АВСДЕФавсдеф"
LOOKALIKE_TO = "ABCDEFABCDEF"
# Texts of prompts, tags and placeholders.
PAGE_TAG = "[Сторінка %d]"
NO_CONTEXT = "[Контекст недоступний]"
NO_TEXT = "[No text]"
OPTION_LETTERS = ("A", "B", "C", "D", "E", "F")
DOCUMENT, QUESTION, CHOICES = "Документ:", "Питання:", "Варіанти:"
ASK_DIRECT, ASK_OPTION = "Відповідь (лише буква):", "Правильний варіант:"
ASK_EVIDENCE = "Знайди відповідний фрагмент тексту, потім вибери правильний варіант."
CHAT_SYSTEM = "Відповідай ЛИШЕ однією великою латинською літерою: A, B, C, D, E або F. Без пояснень."
PAIR_SYSTEM = 'Judge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".'
PAIR_INSTRUCT = "Given a Ukrainian question about a document, determine if the document passage contains the answer to the question."
PAIR_CHARS = 4000
THINK_END = "<think>\n\n</think>\n"
LINE_BREAKS = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(c: Column | str) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(col(c), LINE_BREAKS), strip), lambda x: x != "")


def tokens(c: Column | str) -> Column:
    """Lower-cased Unicode words; without any, the pieces between white space."""
    low = F.lower(col(c))
    return F.when(low.rlike(r"(?U)\w"), F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), F.lit(1))).otherwise(F.filter(F.split(low, r"(?U)\s+"), lambda x: x != ""))


def int_or(c: Column | str, default: int = 1, least: int | None = None) -> Column:
    """An integer, a default where it is missing or empty, at least ``least``."""
    value = F.coalesce(F.nullif(col(c), F.lit("")).try_cast("int"), F.lit(default))
    return value if least is None else F.greatest(value, F.lit(least))


def heading_like(c: Column | str, most: int) -> Column:
    """C4: short, has a letter, and mostly upper case, or ends with a colon, or begins with a digit."""
    line = col(c)
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    return (line != "") & (F.length(line) <= most) & (letters > 0) & ((upper / letters >= 0.6) | line.endswith(":") | line.rlike(r"^\p{Nd}"))


def segments(c: Column | str, window: int, stride: int) -> Column:
    """Array of (seg_no, start, segment): stripped windows; the text's head if all are empty."""
    text = col(c)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - window), F.lit(stride))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), strip(F.substr(text, s + 1, F.lit(window))).alias("segment")))
    kept = F.filter(cut, lambda x: x["segment"] != "")
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.left(text, F.lit(window)).alias("segment")))))


def _summary_steps(text: Column | str, page_num: Column | str, chars: int, heading_chars: int, first_lines: int):
    """The three expressions of C6, each a function of the ones before: first heading, body, whole summary."""
    whole = col(text)
    tag = F.format_string(PAGE_TAG, col(page_num).cast("int"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    step = lambda s, x: F.when(s["n"] >= chars, s).otherwise(F.struct(F.when(s["n"] == 0, x).otherwise(F.concat_ws(" ", s["text"], x)).alias("text"), (s["n"] + F.length(x) + 1).alias("n")))

    def first_heading(every: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(every, lambda x: heading_like(x, heading_chars)), F.lit(1)), F.lit(""))

    def body(every: Column, heading: Column) -> Column:
        kept = F.filter(F.slice(every, 1, first_lines), lambda x: x != heading)
        return strip(F.left(F.aggregate(kept, start, step, lambda s: s["text"]), F.lit(chars)))

    def put(heading: Column, found: Column) -> Column:
        return F.when((heading != "") & (found != ""), F.concat_ws(" ", tag, heading, found)).when(found != "", F.concat_ws(" ", tag, found)).otherwise(F.concat(tag, F.lit(" "), strip(F.left(whole, F.lit(chars)))))

    return first_heading, body, put


def page_summary(text: Column | str, page_num: Column | str, chars: int = 320, heading_chars: int = 120, first_lines: int = 12) -> Column:
    """Page tag, first heading, and the first lines up to ``chars`` characters.

    As the input of a model take ``with_page_summary``: Spark leaves a Python function over lambdas this deep in the plan unevaluated.
    """
    first_heading, body, put = _summary_steps(text, page_num, chars, heading_chars, first_lines)
    return let(lines(text), lambda every: let(first_heading(every), lambda heading: let(body(every, heading), lambda found: put(heading, found))))


def with_page_summary(pages: DataFrame, chars: int = 320, heading_chars: int = 120, first_lines: int = 12) -> DataFrame:
    """C6 by plain projections: adds ``summary`` to (page_num, text, ...)."""
    first_heading, body, put = _summary_steps("text", "page_num", chars, heading_chars, first_lines)
    every, heading, found = F.col("__lines"), F.col("__heading"), F.col("__body")
    return pages.withColumn("__lines", lines("text")).withColumn("__heading", first_heading(every)).withColumn("__body", body(every, heading)).withColumn("summary", put(heading, found)).drop("__lines", "__heading", "__body")


def structure_chunks(text: Column | str, page_num: Column | str, chunk: int = 700, overlap: int = 120, heading_chars: int = 120, least: int = 180) -> Column:
    tag = F.format_string(PAGE_TAG, col(page_num).cast("int"))
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")

    def state(chunks, held, n, heading):
        return F.struct(chunks.alias("chunks"), held.alias("held"), n.cast("int").alias("n"), heading.alias("heading"))

    def flush(s):
        def close(body):
            head = F.when(s["heading"].isNotNull() & (s["heading"] != "") & ~F.contains(body, s["heading"]), F.concat(tag, F.lit(" "), s["heading"])).otherwise(tag)
            out = F.concat(s["chunks"], F.array(F.left(F.concat_ws("\n", head, body), F.lit(chunk + 64))))
            rest = strip(F.right(body, F.lit(overlap))) if overlap > 0 else F.lit("")
            return let(rest, lambda tail: state(out, F.when(tail != "", F.array(tail)).otherwise(empty), F.length(tail), none))

        return F.when(F.size(s["held"]) > 0, let(strip(F.array_join(s["held"], "\n")), close)).otherwise(s)

    def step(s, line):
        def go(title):
            after_title = let(flush(s), lambda c: state(c["chunks"], c["held"], c["n"], line))
            grown = state(s["chunks"], F.concat(s["held"], F.array(line)), s["n"] + F.length(line) + 1, F.when(title & s["heading"].isNull(), line).otherwise(s["heading"]))
            return F.when(title & (s["n"] >= least), after_title).otherwise(let(grown, lambda g: F.when(g["n"] >= chunk, flush(g)).otherwise(g)))

        return let(heading_like(line, heading_chars), go)

    found = F.aggregate(lines(text), state(empty, empty, F.lit(0), none), step, lambda s: flush(s)["chunks"])
    return let(found, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.concat(tag, F.lit("\n"), F.left(col(text), F.lit(chunk))))))


def prompt(context: Column | str, question: Column | str, options: dict[str, Column | str], variant: str = "v4_evidence") -> Column:
    """The prompt of one of three variants."""
    listed = F.concat_ws("\n", *[F.concat(F.lit(f"{k}. "), col(v)) for k, v in options.items()])
    asked = F.concat(F.lit(QUESTION + " "), col(question))
    choices = F.concat(F.lit(CHOICES + "\n"), listed)
    if variant == "direct":
        return F.concat_ws("\n\n", col(context), asked, choices, F.lit(ASK_DIRECT))
    last = F.concat_ws("\n", asked, F.lit(ASK_OPTION)) if variant == "v5_refocus" else F.lit(f"{ASK_EVIDENCE}\n{ASK_OPTION}")
    return F.concat_ws("\n\n", F.concat(F.lit(DOCUMENT + "\n"), col(context)), asked, choices, last)


def answer(c: Column | str) -> Column:
    """Option letter of a reply: leading letter, leading look-alike, letter on its own, any letter, A."""
    text = strip(c)
    upper = F.upper(text)
    none = F.lit("")
    leading = F.regexp_extract(upper, r"^([A-F])", 1)
    alike = F.translate(F.regexp_extract(text, f"^([{LOOKALIKE_FROM}])", 1), LOOKALIKE_FROM, LOOKALIKE_TO)
    alone = F.regexp_extract(upper, r"(?U)\b([A-F])\b", 1)
    some = F.regexp_extract(upper, r"([A-F])", 1)
    return F.coalesce(*[F.nullif(x, none) for x in (leading, alike, alone, some)], F.lit("A"))


def pair_text(query: Column | str, document: Column | str) -> Column:
    """The text of a cross-encoder pair; the document is cut as its model wants."""
    system, user = f"<|im_start|>system\n{PAIR_SYSTEM}<|im_end|>\n<|im_start|>user\n<Instruct>: {PAIR_INSTRUCT}\n<Query>: ", "<|im_end|>\n<|im_start|>assistant\n"
    return F.concat(F.lit(system), col(query), F.lit("\n<Document>: "), F.left(col(document), F.lit(PAIR_CHARS)), F.lit(user + THINK_END))


def augmented(question: Column | str, options: Column, letter: Column | str) -> Column:
    """Question and the text of the predicted option."""
    return strip(F.concat_ws(" ", col(question), F.coalesce(F.try_element_at(options, col(letter)), F.lit(""))))


def dot(a: Column | str, b: Column | str) -> Column:
    """C20: inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fixed6(c: Column | str) -> Column:
    """C16."""
    return F.format_string("%.6f", col(c))


def question_order(c: Column | str) -> list[Column]:
    """C17: numbers first, by value, then other ids by text."""
    number = col(c).try_cast("long")
    return [number.isNull().asc(), number.asc(), col(c).asc()]


def fingerprint(c: Column, bits: int = 1) -> Column:
    """SHA-1 (1) or SHA-256 (256) of a struct's JSON."""
    text = F.to_json(c)
    return F.sha1(text) if bits == 1 else F.sha2(text, bits)


def blocks_text(blocks: Column | str, mode: str = "blocks") -> Column:
    """Non-empty blocks (structs of x, y, text) in reading order, joined by line breaks or spaces."""
    kept = F.filter(F.transform(col(blocks), lambda b: F.struct(F.bround(b["y"], 1).alias("y"), F.bround(b["x"], 1).alias("x"), strip(b["text"]).alias("text"))), lambda b: b["text"] != "")
    numbered = F.transform(kept, lambda b, i: F.struct(b["y"].alias("y"), b["x"].alias("x"), i.alias("i"), b["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda b: b["text"]), "\n" if mode == "blocks" else " ")


def longer_text(blocks: Column | str, words: Column | str) -> Column:
    """A5d: the longer of two texts; the first if equal."""
    return F.when(F.length(col(blocks)) >= F.length(col(words)), col(blocks)).otherwise(col(words))


def with_tables(text: Column | str, tables: Column | str) -> Column:
    """A5e: the text and its tables' rows (arrays of cells), cells joined by bars."""
    rows = F.transform(col(tables), lambda r: F.array_join(F.filter(F.transform(r, strip), lambda x: x.isNotNull() & (x != "")), " | "))
    kept = F.array_join(F.filter(rows, lambda x: x != ""), "\n")
    return strip(F.when(kept == "", strip(text)).otherwise(F.array_join(F.filter(F.array(strip(text), kept), lambda x: x != ""), "\n")))
