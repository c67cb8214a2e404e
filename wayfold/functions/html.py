"""What a stored page shows: title, clickable elements, inputs, headings and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much of a page an observation lists.
MAX_LINKS, MAX_BUTTONS, MAX_CLICKABLE, MAX_INPUTS, MAX_HEADINGS, MAX_TEXTS, MAX_TEXT_NODES = 20, 10, 20, 10, 8, 8, 10
LABEL_CHARS, HREF_CHARS, HEADING_CHARS, TEXT_CHARS, MIN_TEXT = 50, 60, 60, 80, 5
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def visible_html(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")


def inner_text(fragment: Column) -> Column:
    """Text of an element: tags removed, entities resolved, white space trimmed, line breaks as blanks."""
    text = F.regexp_replace(fragment, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(F.regexp_replace(text, r"^\s+|\s+\z", ""), F.lit("\n"), F.lit(" "))


def attribute(tag: Column, name: str) -> Column:
    """Quoted attribute of an opening tag, empty when absent."""
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def elements(html: Column, tags: str) -> Column:
    """Whole elements ``<tag …>…</tag>`` of the given tag alternatives, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tags})\b[^>]*>.*?</(?:{tags})\s*>"), F.lit(0))


def _unique(items: Column, key) -> Column:
    """First occurrence of each key, order kept; the array is already bounded."""
    return F.filter(
        items, lambda x, i: F.array_position(F.transform(items, key), key(x)) == (i + 1).cast("long")
    )


def dedupe_labels(labels: Column, limit: int | None = None) -> Column:
    """Case-insensitive first occurrences, order kept."""
    kept = F.array_compact(_unique(labels, lambda x: F.lower(x)))
    return kept if limit is None else F.slice(kept, 1, limit)


def title(html: Column) -> Column:
    return inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def links(visible: Column) -> Column:
    """First links of the page as ``struct(kind, text, href)``."""
    return F.transform(F.slice(elements(visible, "a"), 1, MAX_LINKS), lambda e: F.struct(
        F.lit("link").alias("kind"), F.substring(inner_text(e), 1, LABEL_CHARS).alias("text"), F.substring(attribute(e, "href"), 1, HREF_CHARS).alias("href")))


def buttons(visible: Column) -> Column:
    found = F.regexp_extract_all(visible, F.lit(r"(?is)<button\b[^>]*>.*?</button\s*>|<input\b[^>]*type\s*=\s*[\"']submit[\"'][^>]*>"), F.lit(0))

    def shape(e: Column) -> Column:
        text = F.coalesce(F.nullif(F.substring(inner_text(e), 1, LABEL_CHARS), F.lit("")), F.nullif(attribute(e, "aria-label"), F.lit("")), attribute(e, "value"))
        return F.struct(F.lit("button").alias("kind"), text.alias("text"), F.lit("").alias("href"))

    return F.transform(F.slice(found, 1, MAX_BUTTONS), shape)


def named_clickable(visible: Column) -> Column:
    """Links then buttons that have a text."""
    return F.filter(F.concat(links(visible), buttons(visible)), lambda c: c["text"] != "")


def clickable(named: Column) -> Column:
    """One element per text whatever its case.  Pass a computed column: it is read once per element."""
    return F.slice(_unique(named, lambda c: F.lower(c["text"])), 1, MAX_CLICKABLE)


def inputs(visible: Column) -> Column:
    """Input fields as ``struct(type, label)``."""
    found = F.regexp_extract_all(visible, F.lit(r"(?is)<(?:input|textarea|select)\b[^>]*>"), F.lit(0))
    shown = F.slice(F.filter(found, lambda e: F.lower(attribute(e, "type")) != "hidden"), 1, MAX_INPUTS)

    def shape(e: Column) -> Column:
        kind = F.coalesce(F.nullif(attribute(e, "type"), F.lit("")), F.lit("text"))
        names = [F.nullif(attribute(e, n), F.lit("")) for n in ("placeholder", "aria-label", "name")]
        return F.struct(kind.alias("type"), F.coalesce(*names, kind).alias("label"))

    return F.transform(shown, shape)


def headings(visible: Column) -> Column:
    """First headings as ``struct(tag, text)``."""
    first = F.slice(elements(visible, "h1|h2|h3"), 1, MAX_HEADINGS)
    shaped = F.transform(first, lambda e: F.struct(F.lower(F.substring(e, 2, 2)).alias("tag"), F.substring(inner_text(e), 1, HEADING_CHARS).alias("text")))
    return F.filter(shaped, lambda h: h["text"] != "")


def texts(visible: Column) -> Column:
    """First paragraphs and list items worth reading, without repetition."""
    cut = F.transform(F.slice(elements(visible, "p|li"), 1, MAX_TEXT_NODES), lambda e: F.substring(inner_text(e), 1, TEXT_CHARS))
    return F.slice(F.array_distinct(F.filter(cut, lambda x: F.length(x) > MIN_TEXT)), 1, MAX_TEXTS)


def form_count(visible: Column) -> Column:
    return F.regexp_count(visible, F.lit(r"(?i)<form\b")).cast("long")


def page_observation(pages, url: str = "url", html: str = "html"):
    """Adds the observed parts of each page and ``observation``, the text summary a model reads."""
    seen = pages.withColumn("_v", visible_html(F.col(html)))
    v = F.col("_v")
    found = seen.withColumns({
        "title": title(F.col(html)), "_named": named_clickable(v), "inputs": inputs(v), "headings": headings(v), "texts": texts(v), "forms": form_count(v)})
    parts = found.withColumn("clickable", clickable(F.col("_named")))

    def block(name: str, head: str, line) -> Column:
        return F.when(F.size(name) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(name, line), "\n")))

    def click_line(c: Column) -> Column:
        arrow = F.when(c["href"] != "", F.concat(F.lit(" → "), c["href"])).otherwise(F.lit(""))
        return F.concat(F.lit("  - ["), c["kind"], F.lit('] "'), c["text"], F.lit('"'), arrow)

    summary = F.concat_ws(
        "\n",
        F.concat(F.lit("URL: "), url), F.concat(F.lit("Title: "), "title"), F.lit(""),
        block("clickable", "Clickable elements (use exact text in quotes for click target):", click_line),
        block("inputs", "Input fields (use label in quotes for type target):", lambda i: F.concat(F.lit("  - ["), i["type"], F.lit('] "'), i["label"], F.lit('"'))),
        block("headings", "Headings:", lambda h: F.concat(F.lit("  - ["), h["tag"], F.lit("] "), h["text"])),
        block("texts", "Page content:", lambda x: F.concat(F.lit("  - "), x)),
        F.when(F.col("forms") > 0, F.concat(F.lit("Forms: "), F.col("forms").cast("string"), F.lit(" visible"))),
    )
    return parts.withColumn("observation", summary).drop("_v", "_named")


# How much the one-line observation lists.
SHORT_ITEMS, SHORT_HEADINGS, SHORT_LABEL, SHORT_HEADING = 5, 3, 30, 40


def compact_observation(pages, url: str = "url", html: str = "html"):
    """Adds ``observation`` in the short form: navigation, buttons, number of inputs, first headings."""
    seen = pages.withColumn("_v", visible_html(F.col(html)))
    v = F.col("_v")
    parts = seen.withColumns({"_links": links(v), "_buttons": buttons(v), "_inputs": inputs(v), "_heads": headings(v)})

    def listed(name: str, head: str, count: int, chars: int) -> Column:
        shown = F.transform(F.slice(name, 1, count), lambda x: F.substring(x["text"], 1, chars))
        return F.when(F.size(name) > 0, F.concat(F.lit(head), F.array_join(shown, ", ")))

    summary = F.concat_ws(
        "\n",
        F.concat(F.lit("Page: "), url, F.lit(" — "), title(F.col(html))),
        listed("_links", "Nav: ", SHORT_ITEMS, SHORT_LABEL),
        listed("_buttons", "Buttons: ", SHORT_ITEMS, SHORT_LABEL),
        F.when(F.size("_inputs") > 0, F.concat(F.lit("Inputs: "), F.size("_inputs").cast("string"), F.lit(" visible"))),
        listed("_heads", "Content: ", SHORT_HEADINGS, SHORT_HEADING),
    )
    return parts.withColumn("observation", summary).drop("_v", "_links", "_buttons", "_inputs", "_heads")
