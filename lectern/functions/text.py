"""Text functions as Spark columns. Each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.patterns import jvm


# ---- small building blocks --------------------------------------------------
def rx(col: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Replace every match. ``flags`` are inline JVM flags such as ``i`` or ``im``."""
    return F.regexp_replace(col, F.lit(_flagged(pattern, flags)), F.lit(replacement))


def matches(col: Column, pattern: str, flags: str = "i") -> Column:
    return col.rlike(_flagged(pattern, flags))


def _flagged(pattern: str, flags: str) -> str:
    return (f"(?{flags})" if flags else "") + jvm(pattern)


#: What ``\\s`` stands for in a rendered pattern.
SPACES = " \t\n\x0b\f\r\u00a0"


def trim_all(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(SPACES))


def collapse(col: Column) -> Column:
    """Every run of white space becomes a blank; single blanks, which are most of them, are not matched."""
    return trim_all(rx(col, r"(?! \S)\s+", " "))


def fixed_point(x: Column, digits: int) -> Column:
    """The double as ``%.<digits>f`` of C prints it: its exact value rounded, a half to the even digit.

    The JVM rounds the shortest spelling instead: 0.4795, a little less than that in binary, becomes 0.480.
    """
    scale = 10**digits
    size = F.abs(x.cast("double"))
    # Two halves of the bits, so that the products below are exact.
    spread = size * F.lit(134217729.0)
    high = spread - (spread - size)

    def beyond(odd: Column) -> Column:
        return (high * (2.0 * scale) - odd) + (size - high) * (2.0 * scale)

    def rounded(n: Column) -> Column:
        low, top = beyond(2 * n - 1), beyond(2 * n + 1)
        down = (low < 0) | ((low == 0) & (n % 2 == 1))
        up = (top > 0) | ((top == 0) & (n % 2 == 1))
        return F.when(down, n - 1).when(up, n + 1).otherwise(n)

    return bind(
        bind(F.floor(size * scale + 0.5), rounded),
        lambda n: F.concat(
            F.when(x < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")
        ),
    )


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def bind(col: Column, body) -> Column:
    """``body(col)`` with ``col`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(col), body), 1)


def some(col: Column, test=lambda x: x != "") -> Column:
    """The value as a row of its own where it passes ``test``, no row elsewhere; it is made once, which a filter does not promise."""
    return F.explode(F.filter(F.array(col), test))


def where_found(col: Column, needles: list[str], change, any_case: bool = True) -> Column:
    """``change(col)`` where the text holds one of the (lower-case) needles in any case, else the text as it is.

    For patterns that match nothing without one: plain letters are found far sooner than a pattern.
    Without ``any_case`` the needles are looked for as they are; lower case is slow where a text has accents.
    """
    def body(c: Column) -> Column:
        low = F.lower(c) if any_case and any(n != n.upper() for n in needles) else c
        found = low.contains(needles[0])
        for needle in needles[1:]:
            found = found | low.contains(needle)
        return F.when(found, change(c)).otherwise(c)

    return bind(col, body)


def where_matched(col: Column, pattern: str, change) -> Column:
    """``change(col)`` where the pattern is found in any case: one search in place of several that need it."""
    return bind(col, lambda c: F.when(matches(c, pattern), change(c)).otherwise(c))


def pairs_with_previous(items: Column, combine) -> Column:
    """``combine(current, previous)`` over an array; previous is null for the first.

    Shifting the array by one keeps the work inside the row and linear.
    """
    return bind(
        items,
        lambda a: F.slice(
            F.zip_with(a, F.concat(F.array(F.lit(None)), a), combine), F.lit(1), F.size(a)
        ),
    )


# ---- tokens -----------------------------------------------------------------
def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(col: Column) -> Column:
    return F.array_distinct(tokens(col))


def content_terms(col: Column) -> Column:
    """Tokens without stop words, order and repeats kept."""
    return F.filter(tokens(col), lambda t: ~t.isin(fixed.STOPWORDS))


def scope_stem(term: Column) -> Column:
    return (
        F.when(term.endswith("ies") & (F.length(term) > 4), F.concat(_cut(term, 3), F.lit("y")))
        .when(term.endswith("s") & (F.length(term) > 3), _cut(term, 1))
        .otherwise(term)
    )


def _cut(term: Column, n: int) -> Column:
    return F.substring(term, F.lit(1), F.length(term) - n)


def scope_terms(col: Column) -> Column:
    return F.transform(content_terms(col), scope_stem)


def word_phrases(words: Column, shortest: int, longest: int) -> Column:
    """All runs of ``shortest`` to ``longest`` adjacent words, as phrases."""
    def of_size(w: Column, size: int) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1))
        return F.coalesce(
            F.transform(starts, lambda s: F.array_join(F.slice(w, s, F.lit(size)), " ")),
            F.array().cast("array<string>"),
        )

    return bind(
        words,
        lambda w: F.array_distinct(F.flatten(F.array(*[of_size(w, n) for n in range(shortest, longest + 1)]))),
    )


def word_set_cosine(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        shared / F.sqrt(F.size(left).cast("double") * F.size(right)),
    ).otherwise(F.lit(0.0))


def token_estimate(col: Column) -> Column:
    return F.ceil(F.length(F.coalesce(col, F.lit(""))) / F.lit(fixed.CHARS_PER_TOKEN))


# ---- cleaning ---------------------------------------------------------------
def searchable_text(col: Column) -> Column:
    out = rx(F.coalesce(col, F.lit("")), fixed.DATA_LINK, " ", "i")
    out = rx(out, fixed.DATA_IMAGE, " ", "i")
    out = rx(out, fixed.BASE64_32, " ", "i")
    return collapse(out)


def has_embedded_binary(col: Column) -> Column:
    return matches(col, r"data:image/") | matches(col, fixed.BASE64_32)


def is_searchable(col: Column) -> Column:
    return F.length(searchable_text(col)) >= fixed.MIN_SEARCHABLE_CHARS


def is_bad_chunk(col: Column, product_name: str | None = None) -> Column:
    """Chunk that should not have been indexed: binary left-overs or a print footer."""
    bad = matches(col, r"data:image") | matches(col, fixed.BASE64_160) | col.contains("\\.")
    if product_name:
        bad = bad | matches(col, footer_pattern(product_name, anchored=False))
    return bad


def footer_pattern(product_name: str, anchored: bool = True) -> str:
    """Print footer ``<product> page n [of m]``; the product name is the caller's."""
    name = "".join(c if c.isalnum() or c == " " else "\\" + c for c in product_name)
    if anchored:
        return rf"^{name}\s+page\s+\d+(?:\s+of\s+\d+)?$"
    return rf"{name} page\s+\d+"


def strip_artifacts(col: Column) -> Column:
    """Embedded binaries, control characters, scripts and layout tags out."""
    def links(c: Column) -> Column:
        return rx(rx(c, fixed.DATA_LINK_LOOSE, "", "i"), fixed.DATA_ANY, "", "i")

    def tags(c: Column) -> Column:
        for pattern in (fixed.SCRIPT_BLOCK, fixed.STYLE_BLOCK, fixed.LAYOUT_TAG):
            c = rx(c, pattern, "", "i")
        return c

    out = where_found(F.coalesce(col, F.lit("")), ["data:"], links)
    # A run is tried from its start only.
    out = rx(out, r"(?<![a-z0-9+/=])" + fixed.BASE64_160, "", "i")
    out = F.replace(out, F.lit("\\."), F.lit("."))
    out = F.regexp_replace(out, F.lit(fixed.CONTROL_CHARS), F.lit(""))
    return unix_newlines(where_found(out, ["<"], tags))


def single_gaps(col: Column) -> Column:
    """One blank line where there are several."""
    return where_found(col, ["\n\n\n"], lambda c: rx(c, r"\n{3,}", "\n\n"))


def unix_newlines(col: Column) -> Column:
    return where_found(col, ["\r"], lambda c: rx(c, r"\r\n?", "\n"))


def tidy_blank_lines(col: Column) -> Column:
    return trim_all(single_gaps(where_found(col, [" \n", "\t\n"], lambda c: rx(c, r"[ \t]+\n", "\n"))))


def normalise_newlines(col: Column) -> Column:
    return tidy_blank_lines(unix_newlines(F.coalesce(col, F.lit(""))))


def drop_adjacent_repeats(col: Column) -> Column:
    """Of equal neighbouring lines (case and spacing aside) keep the first.

    Blank lines are kept and do not separate neighbours.
    """
    def of_lines(lines: Column) -> Column:
        fresh = pairs_with_previous(
            F.filter(lines, lambda x: x["norm"] != ""),
            lambda x, prev: F.struct(
                x["pos"].alias("pos"), x["line"].alias("line"),
                (prev.isNull() | (x["norm"] != prev["norm"])).alias("keep"),
            ),
        )
        kept = F.transform(
            F.filter(fresh, lambda x: x["keep"]),
            lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line")),
        )
        blank = F.transform(
            F.filter(lines, lambda x: x["norm"] == ""),
            lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line")),
        )
        ordered = F.sort_array(F.concat(kept, blank))
        return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")

    def numbered(text: Column) -> Column:
        # The spacing of all lines at once: a pattern a text, not two a line.
        even = F.regexp_replace(F.lower(text), F.lit(f"[{SPACES.replace(chr(10), '')}]+"), F.lit(" "))
        both = F.zip_with(F.split(text, "\n"), F.split(even, "\n"), lambda line, norm: F.struct(line.alias("line"), norm.alias("norm")))
        return F.transform(both, lambda x, i: F.struct(i.alias("pos"), F.trim(x["norm"]).alias("norm"), x["line"].alias("line")))

    return bind(bind(col, numbered), of_lines)


def structured_clean(col: Column) -> Column:
    """Whole-document clean for text that has no page markers."""
    return tidy_blank_lines(drop_adjacent_repeats(strip_artifacts(col)))


# ---- one-glyph lines --------------------------------------------------------
def _is_glyph_line(line: Column) -> Column:
    return trim_all(line).rlike(fixed.ONE_GLYPH_LINE)


def glyph_line_stats(col: Column) -> Column:
    """Struct of non-blank line count, one-glyph line count and longest such run."""
    lines = F.filter(F.split(F.coalesce(col, F.lit("")), "\n"), lambda x: trim_all(x) != "")
    marks = F.array_join(F.transform(lines, lambda x: F.when(_is_glyph_line(x), "1").otherwise("0")), "")
    return bind(
        marks,
        lambda m: F.struct(
            F.length(m).alias("lines"),
            F.length(F.regexp_replace(m, F.lit("0"), F.lit(""))).alias("single"),
            F.array_max(F.transform(F.split(m, "0+"), F.length)).alias("longest"),
        ),
    )


def is_vertical(stats: Column) -> Column:
    share = stats["single"].cast("double") / stats["lines"]
    return (stats["longest"] >= 10) | ((stats["lines"] >= 20) & (share > 0.3))


def drop_glyph_runs(col: Column, shortest: int = 6) -> Column:
    """Leave out runs of ``shortest`` or more one-glyph lines."""
    lines = F.split(F.coalesce(col, F.lit("")), "\n")
    marks = F.array_join(F.transform(lines, lambda x: F.when(_is_glyph_line(x), "1").otherwise("0")), "")
    keep = F.flatten(
        F.transform(
            F.regexp_extract_all(marks, F.lit("1+|0+"), F.lit(0)),
            lambda run: F.array_repeat(
                ~(run.startswith("1") & (F.length(run) >= shortest)), F.length(run)
            ),
        )
    )
    marked = F.zip_with(lines, keep, lambda line, k: F.struct(line.alias("line"), k.alias("keep")))
    return F.array_join(F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["line"]), "\n")


# ---- entities and tags ------------------------------------------------------
def decode_entities(col: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def escape_xml(col: Column) -> Column:
    col = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def escape_html(col: Column) -> Column:
    col = F.replace(F.coalesce(col, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(col, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def run_text(xml: Column) -> Column:
    """Text of ``w:t`` / ``a:t`` runs joined, entities decoded."""
    runs = F.regexp_extract_all(xml, F.lit(r"(?s)<([wa]):t(?:\s[^>]*)?>(.*?)</\1:t>"), F.lit(2))
    return collapse(F.array_join(F.transform(runs, decode_entities), ""))


def markup_text(html: Column) -> Column:
    """HTML or XML to text: headings become ``#``, list items ``-``."""
    out = rx(F.coalesce(html, F.lit("")), fixed.SCRIPT_BLOCK, "", "i")
    out = rx(out, fixed.STYLE_BLOCK, "", "i")
    out = rx(out, r"(?s)<!--.*?-->", "")
    for level in range(1, 7):
        out = rx(out, rf"<h{level}(?:\s[^>]*)?>", "\n\n" + "#" * level + " ", "i")
    out = rx(out, r"<li(?:\s[^>]*)?>", "\n- ", "i")
    out = rx(out, r"</?(?:p|div|ul|ol|h[1-6]|li|table|tr|article|nav|br)(?:\s[^>]*)?/?>", "\n", "i")
    out = rx(out, fixed.ANY_TAG, " ")
    out = decode_entities(out)
    out = rx(out, r"[ \t]+", " ")
    return trim_all(rx(out, r"\s*\n\s*", "\n"))


# ---- answers ----------------------------------------------------------------
def explicit_word_count(query: Column) -> Column:
    found = F.regexp_extract(F.coalesce(query, F.lit("")), "(?i)" + jvm(fixed.WORD_COUNT), 1)
    return bind(blank_to_null(found).cast("int"), lambda n: F.when(n.between(1, 2000), n))


def plain_summary(col: Column) -> Column:
    out = rx(F.coalesce(col, F.lit("")), r"</(?:p|div|li|h[1-6])\s*>", "\n", "i")
    out = rx(out, r"<br\s*/?>", "\n", "i")
    out = rx(out, fixed.ANY_TAG, " ")
    out = rx(out, r"^\s*#{1,6}\s*", "", "m")
    out = rx(out, r"^\s*(?:[-*•]|\d+[.)])\s+", "", "m")
    out = rx(out, r"\*{1,3}|_{1,3}|`", "")
    out = rx(out, r"\s*\(Source:\s*[^)]+\)", "", "i")
    return collapse(out)


def clean_citations(col: Column) -> Column:
    out = rx(F.coalesce(col, F.lit("")), r"\s*\(\s*Source\s*:\s*Chunk\s*\d+[^)]*\)", "", "i")
    out = rx(out, r"\s*\(Source:\s*Chunk[^)]+\)", "", "i")
    out = rx(out, r"\s*Chunk\s*\d+", "", "i")
    out = rx(out, r"(\(Source:\s*[^)]+\))\s*\1+", "$1", "i")
    return trim_all(rx(out, r"\n{3,}", "\n\n"))


def limit_words(answer: Column, wanted: Column) -> Column:
    """Cut to ``wanted`` words once the text is over it by more than 15 %."""
    def cut(text: Column, words: Column) -> Column:
        short = rx(F.array_join(F.slice(words, F.lit(1), wanted), " "), r"[,:;]+\z", "")
        closed = bind(short, lambda c: F.when(c.rlike(r"[.!?]\z"), c).otherwise(F.concat(c, F.lit("."))))
        fits = wanted.isNull() | (wanted == 0) | (F.size(words) <= F.ceil(wanted * F.lit(1.15)))
        return F.when(fits, text).otherwise(closed)

    return bind(
        clean_citations(answer),
        lambda text: bind(
            F.regexp_extract_all(text, F.lit(jvm(r"\S+")), F.lit(0)), lambda words: cut(text, words)
        ),
    )


def title_case(col: Column) -> Column:
    return F.array_join(
        F.transform(
            F.split(col, jvm(r"\s+")),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(_rest(w))),
        ),
        " ",
    )


def _rest(word: Column) -> Column:
    return F.substring(word, F.lit(2), F.length(word))


def professional_title(topic: Column, intent: Column, query: Column) -> Column:
    return bind(F.lower(F.coalesce(query, F.lit(""))), lambda q: _title(topic, intent, q))


def _title(topic: Column, intent: Column, q: Column) -> Column:
    def has(*words: str) -> Column:
        hit = q.contains(words[0])
        for word in words[1:]:
            hit = hit | q.contains(word)
        return hit

    style = (
        F.when(has("professional"), "Professional ")
        .when(has("detailed", "more detail", "more content", "large content", "explain more", "explain in detail"), "Detailed ")
        .when(has("comprehensive"), "Comprehensive ")
        .when(has("executive"), "Executive ")
        .when(has("brief", "short"), "Brief ")
        .otherwise("")
    )
    operation = (
        F.when(
            has("summary", "summarize", "summarise") | (F.upper(F.coalesce(intent, F.lit("ANSWER"))) == "SUMMARY"),
            "Summary",
        )
        .when(has("bullet", "points", "key point"), "Key Points:")
        .when(has("analysis", "analyze"), "Analysis")
        .when(has("explain", "explanation"), "Explanation")
        .when(has("guide", "how to", "steps"), "Guide to")
        .when(has("report"), "Report")
        .otherwise("Overview")
    )
    subject = title_case(
        F.when(topic.isNull() | topic.isin("", "null", "undefined"), F.lit("Selected Document Context")).otherwise(topic)
    )
    head = bind(
        operation,
        lambda op: F.when(op == "Key Points:", F.lit("Key Points: "))
        .when(op == "Guide to", F.concat(style, op, F.lit(" ")))
        .otherwise(F.concat(style, op, F.lit(" of "))),
    )
    return trim_all(F.concat(head, subject))


def comparable(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), F.lit("[^a-z0-9]"), F.lit(""))


def fix_title(answer: Column, query: Column, intent: Column, topic: Column) -> Column:
    """Swap a leading title that only repeats the question for a composed one."""
    leading = r"(?i)\A(?:#+|<h[123][^>]*>)\s*([^<\n]+)(?:</h[123]>|\n)"
    marked = F.regexp_extract(answer, leading, 0)
    first_line = F.split(trim_all(answer), "\n")[0]
    usable_line = (first_line != "") & (F.length(first_line) < 100) & ~first_line.rlike("[<>]")
    found = F.struct(
        F.when(marked != "", marked).when(usable_line, first_line).alias("old"),
        F.when(marked != "", trim_all(F.regexp_extract(answer, leading, 1)))
        .when(usable_line, trim_all(rx(first_line, r"\A[#\s]+", "")))
        .alias("title"),
        professional_title(topic, intent, query).alias("fresh"),
    )

    def swap(f: Column) -> Column:
        a, b = comparable(f["title"]), comparable(query)
        repeats = (a != "") & (b != "") & (b.contains(a) | a.contains(b))
        new = F.when(
            f["old"].contains("<h") | f["old"].startswith("#"), replace_first(f["old"], f["title"], f["fresh"])
        ).otherwise(F.concat(F.lit("<h3>"), f["fresh"], F.lit("</h3>\n")))
        return F.when(repeats, replace_first(answer, f["old"], new)).otherwise(answer)

    return bind(found, swap)


def replace_first(col: Column, old: Column, new: Column) -> Column:
    return bind(
        F.instr(col, old),
        lambda at: F.when(
            at > 0,
            F.concat(F.substring(col, F.lit(1), at - 1), new, F.substring(col, at + F.length(old), F.length(col))),
        ).otherwise(col),
    )


# ---- report text ------------------------------------------------------------
_HAS_STRUCTURE = r"(?m)^\s*(?:#{1,6}\s+|[-*]\s+|\d+\.\s+)"


def numbered_list_from_line(col: Column, heading: str = "###") -> Column:
    """Numbered points run together on one line become a list; null when not such a line."""
    def build(compact: Column, pieces: Column) -> Column:
        lead = F.trim(pieces[0])
        items = F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces)),
            lambda p: F.concat(
                F.regexp_extract(p, r"\A\s*(\d{1,2})\.", 1), F.lit(". "),
                trim_all(rx(rx(p, r"\A\s*\d{1,2}\.\s+", ""), r"\s+\d+\.\s*\z", "")),
            ),
        )
        return bind(
            F.filter(items, lambda x: F.length(x) > 3),
            lambda kept: F.when(
                (compact != "")
                & ~matches(compact, r"</?[a-z][^>]*>")
                & (F.size(pieces) >= 3)
                & (F.length(lead) <= 100)
                & (F.size(kept) >= 2),
                F.concat(
                    F.when(lead != "", F.concat(F.lit(heading + " "), lead, F.lit("\n\n"))).otherwise(""),
                    F.array_join(kept, "\n"),
                ),
            ),
        )

    # The pieces start at " 1. A"; a blank in front lets a leading number count too.
    numbered = bind(
        collapse(F.coalesce(col, F.lit(""))),
        lambda c: bind(F.split(F.concat(F.lit(" "), c), r"\s(?=\d{1,2}\.\s+[A-Z])"), lambda p: build(c, p)),
    )
    return F.when(~F.coalesce(col, F.lit("")).rlike(jvm(_HAS_STRUCTURE)), numbered)


def list_from_heading(col: Column) -> Column:
    """A heading that swallowed a dashed list: struct of heading and items, else null.

    One-word pieces are halves of a compound word and are joined to the next piece.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def fold(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, r"\s*-\s*"), trim_all), lambda p: p != "")
        return F.aggregate(
            parts,
            empty,
            lambda acc, p: F.when(
                p.rlike(r"\A(?:[A-Z]{1,8}|[A-Z][a-z]{1,18})\z"),
                F.struct(acc["done"].alias("done"), F.concat(acc["open"], p, F.lit("-")).alias("open")),
            ).otherwise(
                F.struct(
                    F.concat(acc["done"], F.array(F.concat(acc["open"], p))).alias("done"), F.lit("").alias("open")
                )
            ),
            lambda acc: F.when(
                acc["open"] != "",
                F.concat(acc["done"], F.array(F.regexp_replace(acc["open"], F.lit(r"-\z"), F.lit("")))),
            ).otherwise(acc["done"]),
        )

    def shape(parts: Column) -> Column:
        items = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        usable = (F.size(parts) >= 3) & ~F.exists(items, lambda p: F.length(p) < 2)
        return F.when(usable, F.struct(F.get(parts, F.lit(0)).alias("heading"), items.alias("items")))

    def dashed(text: Column) -> Column:
        return (F.length(text) >= 70) & (F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit(""))) >= 3)

    # Only a text with enough dashes is cut.
    return bind(print_text(col), lambda text: F.when(dashed(text), bind(fold(text), shape)))


def repair_punctuation(col: Column, times: int = 1) -> Column:
    cut, closing = fixed.CUT_QUOTE

    def repaired(c: Column) -> Column:
        for n in range(times, 0, -1):
            for twice, once, mark in fixed.MOJIBAKE:
                c = F.replace(c, F.lit(twice if n == 2 else once), F.lit(mark))
        return F.replace(c, F.lit(cut), F.lit(closing))

    # Every misread mark starts with the first two letters of its kind.
    heads = {cut[:2], *(once[:2] for _, once, _ in fixed.MOJIBAKE), *(twice[:2] for twice, _, _ in fixed.MOJIBAKE if times > 1)}
    return where_found(col, sorted(heads), repaired, any_case=False)


def print_text(col: Column) -> Column:
    out = F.regexp_replace(F.coalesce(col, F.lit("")), F.lit(fixed.CONTROL_CHARS), F.lit(""))
    out = repair_punctuation(out, 2)
    return collapse(F.replace(out, F.lit("**"), F.lit("")))


def drop_source_blocks(col: Column) -> Column:
    def dropped(out: Column) -> Column:
        out = rx(out, r"^\s*#{1,6}\s+Source:\s*.+?(?:\r?\n|\z)", "", "im")
        out = rx(
            out, r"(?:^|\r?\n)\s*#{1,6}\s+Sources\s*\r?\n\s*[-*]\s*.+?(?=\r?\n\s*\r?\n|$)", "", "im"
        )
        return rx(out, r"^\s*#{1,6}\s+Sources\s*-\s*.+?(?:\r?\n|\z)", "", "im")

    return trim_all(where_matched(F.coalesce(col, F.lit("")), r"#\s+Source", dropped))


def single_title(col: Column) -> Column:
    """The first level-one heading stays; later ones drop to level two."""
    def lower_rest(c: Column, at: Column) -> Column:
        head, tail = F.substring(c, F.lit(1), at), F.substring(c, at + 1, F.length(c))
        lowered = rx(tail, r"(?m)^#[ \t]\s*(\S[^\n]*?)[ \t]*$", "## $1")
        return F.when(at > 0, F.concat(head, lowered)).otherwise(c)

    return bind(
        col, lambda c: bind(F.regexp_instr(c, F.lit(r"(?m)^#\s+\S")), lambda at: lower_rest(c, at))
    )


def distinct_sections(col: Column) -> Column:
    """Sections equal but for case and spacing are kept once, in place."""
    sections = F.transform(
        F.split(F.coalesce(col, F.lit("")), r"\n(?=#{1,3}\s+\S)"),
        lambda s: trim_all(single_gaps(s)),
    )
    keyed = F.sort_array(
        F.transform(
            F.filter(sections, lambda s: s != ""),
            lambda s, i: F.struct(F.lower(collapse(s)).alias("key"), i.alias("pos"), s.alias("text")),
        )
    )
    first = F.filter(
        pairs_with_previous(
            keyed,
            lambda x, prev: F.struct(
                x["pos"].alias("pos"), x["text"].alias("text"),
                (prev.isNull() | (x["key"] != prev["key"])).alias("keep"),
            ),
        ),
        lambda x: x["keep"],
    )
    return F.array_join(F.transform(F.sort_array(first), lambda x: x["text"]), "\n\n")


REPORT_FIXES = (
    # ---- fixed values: report repairs, applied in this order ----
    # The last value: letters that stand in the text wherever the pattern matches.
    (r"(?=\s)(?<=[^\n])\s+(#{1,3}\s+(?=[A-Z0-9]))", "\n\n$1", "", ["#"]),
    (r"^#\s*Explanation of\s+", "# ", "im", ["#"]),
    (r"\b([Rr])\s+ecommendation\b", "$1ecommendation", "", ["ecommendation"]),
    (r"([A-Za-z])[ \t]+-[ \t]+([A-Za-z])", "$1-$2", "", [" -", "\t-"]),
)
GLUED_HEADINGS = (
    (r"\s+Business Insight\s+(?=[A-Z])", "\n\n### Business Insight:\n", "i"),
    (r"\s+(Business Insight:)", "\n\n### $1", "i"),
    (r"\s+(Expected Outcome:)", "\n\n### $1", "i"),
)
ANY_GLUED_HEADING = r"(?=[BE])(?:Business Insight|Expected Outcome:)"
HEADING_FIXES = (
    (
        r"^(#{1,3})\s+(Conclusion|Executive Summary|Strategic Recommendations|References|Sources)\s+(.+)$",
        "$1 $2\n$3", "im",
    ),
    (r"^(?:#{1,3}\s+)?Recommendation\s+(\d+)\s+(.+)$", "## Recommendation $1\n$2", "im"),
    (r"^(#{1,3})\s+\d+\.\s+(.+)$", "## $2", "m"),
    (r"^(##\s+Discount Intensity)\s*=\s*(.+)$", "$1\n$2", "im"),
)


def polish_report(col: Column) -> Column:
    def all_of(fixes):
        def change(c: Column) -> Column:
            for pattern, replacement, flags in fixes:
                c = rx(c, pattern, replacement, flags)
            return c

        return change

    out = F.coalesce(col, F.lit(""))
    for *fix, needles in REPORT_FIXES:
        out = where_found(out, needles, all_of([fix]), any_case=False)
    out = all_of(HEADING_FIXES)(where_matched(out, ANY_GLUED_HEADING, all_of(GLUED_HEADINGS)))
    out = trim_all(single_gaps(out))
    out = distinct_sections(single_title(out))
    return trim_all(single_gaps(out))


def export_text(col: Column, product_name: str | None = None) -> Column:
    """Text fit for an export: newlines, punctuation, footers, vertical runs, report polish."""
    out = unix_newlines(F.coalesce(col, F.lit("")))
    out = repair_punctuation(out)
    out = drop_glyph_runs(out)
    if product_name:
        out = rx(out, r"^[ \t]*" + footer_pattern(product_name)[1:-1] + r"[ \t]*(?:\n|\z)", "", "im")
    out = polish_report(out)
    return trim_all(single_gaps(out))


def safe_file_stem(col: Column, longest: int = 60) -> Column:
    out = trim_all(rx(F.coalesce(col, F.lit("")), r"[^\w\- ]+", ""))
    return F.substring(rx(out, r"\s+", "_"), 1, longest)


def clean_label(col: Column, longest: int) -> Column:
    out = F.regexp_replace(F.coalesce(col, F.lit("")), F.lit("[<>]"), F.lit(""))
    out = F.regexp_replace(out, F.lit(r"[\x00-\x1f\x7f]"), F.lit(" "))
    return F.substring(collapse(out), 1, longest)


# ---- claims in an answer ----------------------------------------------------
def claim_sentences(answer: Column) -> Column:
    out = rx(F.coalesce(answer, F.lit("")), fixed.ANY_TAG, " ")
    out = rx(out, fixed.SOURCE_NOTE_ROUND, " ", "i")
    out = rx(out, fixed.SOURCE_NOTE_SQUARE, " ", "i")
    pieces = F.split(collapse(out), r"(?<=[.!?])\s+")
    bare = F.transform(
        pieces,
        lambda s: rx(rx(rx(trim_all(s), r"\A#{1,6}\s*", ""), r"\A[-*•\d+.)]\s*", ""), r"\*{1,3}", ""),
    )
    return F.filter(
        bare,
        lambda s: (F.length(s) >= 25)
        & ~matches(s, fixed.INTRO_SENTENCE)
        & ~(s.rlike(jvm(fixed.LABEL_SENTENCE)) & (F.length(s) < 80)),
    )


def is_refusal(col: Column) -> Column:
    return matches(col, fixed.REFUSAL)
