"""URLs and hyperlinks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PDF_MARKS = (
    "/api/media/", "/api/asset/", "/static-files/", "/sites/default/files/", "/dam/jcr:", "/-/media/", "/getmedia/",
    "/documents/", "/files/",
)
DRILLDOWN = r"(?i)^/(?:[a-z]{2}/)?(?:financials|reports|results|annual|annual-reports|financial-reports)/[^/]+/?$"
HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*['"]([^'"]+)['"][^>]*>"""
ANCHOR = r"""(?i)(<a\b[^>]*?\bhref\s*=\s*['"][^'"]+['"][^>]*>)"""
EMBEDDED_PDF = r"""(?i)(?:href|src|action)\s*=\s*['"]([^'"]+\.pdf[^'"]*)['"]"""
LABEL = r"""(?i)\b(?:aria-label|title|download)\s*=\s*['"]([^'"]+)['"]"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
#: Suffixes under which names are registered with two labels; others are taken to have one.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn",
    "com.hk", "com.sg", "com.tr", "com.mx", "com.ar", "co.za", "co.in", "co.kr", "com.tw", "co.il",
)
FILE_SUFFIXES = (".pdf", ".htm", ".html", ".xml", ".txt", ".xlsx", ".xbrl", ".zip")
CONTENT_SUFFIXES = {
    "application/pdf": ".pdf", "text/html": ".html", "application/xhtml+xml": ".html", "text/plain": ".txt",
    "application/xml": ".xml", "application/json": ".json",
}


def host(url: Column) -> Column:
    """Host name in lower case without a leading ``www.``; null for relative URLs."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def registrable(host_name: Column) -> Column:
    """The registered domain: the last two labels, or three under the listed suffixes; null for one label or an address. ``crawl.registered_domains`` takes a table of suffixes."""
    two, three = F.substring_index(host_name, ".", -2), F.substring_index(host_name, ".", -3)
    labels = F.size(F.split(host_name, r"\."))
    named = F.when(two.isin(*TWO_LABEL_SUFFIXES), F.when(labels >= 3, three)).when(labels >= 2, two)
    return F.when(~host_name.rlike(r"^[0-9.]+$"), named)


def same_org(a: Column, b: Column) -> Column:
    """Equal registered domains; equal hosts where there is none; false without a host."""
    ha, hb = host(a), host(b)
    ra, rb = registrable(ha), registrable(hb)
    return F.coalesce(F.when(ra.isNull() | rb.isNull(), ha == hb).otherwise(ra == rb), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def looks_like_pdf(url: Column) -> Column:
    u = F.regexp_replace(F.lower(url), r"[#?].*$", "")
    found = u.endswith(".pdf")
    for mark in PDF_MARKS:
        found = found | u.contains(mark)
    return found


def is_drilldown(url: Column) -> Column:
    return path(url).rlike(DRILLDOWN)


def anchors(html: Column) -> Column:
    """The open tags of hyperlinks: what stands between them and the closing tags doesn't matter."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))


def anchor_href(tag: Column) -> Column:
    return F.regexp_extract(tag, HREF, 1)


def anchor_label(tag: Column, most: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_extract(tag, LABEL, 1)), 1, most)


#: A link with all up to its closing tag, the next link or the end.
LINKED = r"""(?is)(<a\b[^>]*?\bhref\s*=\s*['"][^'"]+['"][^>]*>.*?)(?=</a\b|<a\b|\z)"""
#: What makes an address a document's where a source doesn't say.
DOCUMENT_LINK = r"\.pdf($|\?)"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def linked_elements(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LINKED), F.lit(1))


def unescaped(text: Column) -> Column:
    """The few named characters that addresses and link texts hold."""
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def element_text(element: Column) -> Column:
    """The text of a link without tags and outer space; null if there is none."""
    inner = F.regexp_replace(F.regexp_replace(element, r"(?is)^<a\b[^>]*>", ""), r"<[^>]*>", "")
    return F.nullif(F.regexp_replace(unescaped(inner), r"(?U)^\s+|\s+$", ""), F.lit(""))


def embedded_pdfs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(EMBEDDED_PDF), F.lit(1))


def page_title(html: Column, most: int = 160) -> Column:
    from ledgerloom.functions.text import collapse

    return F.coalesce(F.nullif(F.substring(collapse(F.regexp_extract(html, TITLE, 1)), 1, most), F.lit("")), F.lit("(no title)"))


SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
ROOT = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
#: Path, query and fragment of what follows scheme and host.
PARTS = r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$"


def merged_path(base_path: Column, url_path: Column) -> Column:
    """``url_path`` as seen from ``base_path``: relative paths start at the base's folder, and dot segments are walked."""
    from ledgerloom.functions.reports import let

    none = F.array().cast("array<string>")

    def relative(x: Column) -> Column:
        folder = F.when(F.get(x["base"], F.size(x["base"]) - 1) == "", x["base"]).otherwise(F.slice(x["base"], 1, F.size(x["base"]) - 1))
        return let(F.concat(folder, x["own"]), lambda joined: F.filter(joined, lambda s, k: (s != "") | (k == 0) | (k == F.size(joined) - 1)))

    def walked(segments: Column) -> Column:
        last = F.get(segments, F.size(segments) - 1)
        kept = F.aggregate(segments, none, lambda at, s: F.when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(s == ".", at).otherwise(F.concat(at, F.array(s))))
        return F.array_join(F.concat(kept, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/")

    own = F.split(url_path, "/")
    segments = F.when(url_path.startswith("/"), own).otherwise(let(F.struct(F.split(base_path, "/").alias("base"), own.alias("own")), relative))
    return let(let(segments, walked), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def resolve(base: Column, url: Column) -> Column:
    """``url`` as seen from ``base`` (an absolute address with a host, else the result is null for relative ones). Built-in functions only."""
    from ledgerloom.functions.reports import let

    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme, root = F.lower(F.regexp_extract(base, SCHEME, 1)), F.regexp_extract(base, ROOT, 1)

    def of_parts(x: Column) -> Column:
        below = F.substring(base, F.length(x["root"]) + 1, F.lit(1 << 20))
        path_, query, fragment = (F.regexp_extract(x["url"], PARTS, k) for k in (1, 2, 3))
        own_query = F.when(query == "?", "").otherwise(query)
        base_path, base_query = F.regexp_extract(below, PARTS, 1), F.regexp_extract(below, PARTS, 2)
        tail = F.when(fragment == "#", "").otherwise(fragment)
        same = F.when(path_ == "", F.concat(base_path, F.when(own_query == "", base_query).otherwise(own_query))).otherwise(F.concat(merged_path(base_path, path_), own_query))
        return (F.when(x["url"] == "", base).when(base == "", x["url"])
            .when(x["url"].rlike(SCHEME), x["url"])
            .when(x["url"].startswith("//"), F.concat(x["scheme"], F.lit(":"), x["url"]))
            .when(x["root"] != "", F.concat(x["scheme"], F.substring(x["root"], F.length(x["scheme"]) + 1, F.lit(1 << 20)), same, tail)))

    return let(F.struct(clean.alias("url"), scheme.alias("scheme"), root.alias("root")), of_parts)


def file_format(local_path: Column, url: Column) -> Column:
    """pdf or html by the file's extension, else by the URL's (without its query), else unknown."""
    kind = lambda name: F.when(name.rlike(r"(?i)\.pdf$"), "pdf").when(name.rlike(r"(?i)\.html?$"), "html")
    return F.coalesce(kind(local_path), kind(F.regexp_replace(url, r"[?].*$", "")), F.lit("unknown"))


def file_suffix(url: Column, content_type: Column) -> Column:
    """The URL's extension if it is a known one, else the content type's, else .bin."""
    own = F.lower(F.regexp_extract(path(url), r"(\.[A-Za-z0-9]+)$", 1))
    by_type = F.lit(".bin")
    for kind, suffix in CONTENT_SUFFIXES.items():
        by_type = F.when(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))) == kind, suffix).otherwise(by_type)
    return F.when(own.isin(*FILE_SUFFIXES), own).otherwise(by_type)


def archive_raw_url(url: Column, timestamp: Column) -> Column:
    """An archived page's address without the archive's frame; null without either part."""
    mark = F.concat(F.lit("/"), timestamp, F.lit("/"))
    at = F.instr(url, mark)
    raw = F.concat(F.substring(url, F.lit(1), at - 1), F.lit("/"), timestamp, F.lit("id_/"), F.substring(url, at + F.length(mark), F.lit(1 << 20)))
    return F.when((url != "") & (timestamp != ""), F.when(at > 0, raw).otherwise(url))


def scrape_status(discover_only: Column, found: Column, downloaded: Column, failures: Column, page_errors: Column) -> Column:
    """ok, partial or failed."""
    done = F.when((failures == 0) & ~page_errors, "ok").when(downloaded == 0, "failed").otherwise("partial")
    return F.when(page_errors & (found == 0), "failed").when(discover_only, F.when(page_errors, "partial").otherwise("ok")).otherwise(done)
