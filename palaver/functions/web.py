"""URLs and HTML.  Column in, Column out."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palaver.functions.text import strip

URL = r"(?i)(https?://[^\s<>\"\)\]\}]+)"
INVISIBLE_END = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}]+$"
_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"

# fixed values: addresses that are never crawled
SKIP_EXTENSIONS = (
    ".pdf .jpg .jpeg .png .gif .webp .svg .css .js .mjs .map .zip .tar .gz .rar .7z .docx .doc "
    ".xlsx .xls .pptx .ppt .mp4 .mp3 .webm .mov .avi .m4a .ico .woff .woff2 .ttf"
).split()
SKIP_PATH_PARTS = (
    "/wp-json/ /wp-admin/ /wp-content/uploads/ /wp-content/plugins/ /admin/ /login /logout "
    "/signin /sign-in /register /api/ /feed/ /rss/ /sitemap /.well-known/ /embed/ /oembed/"
).split()
SKIP_HOSTS = (
    "forms.gle forms.google.com linkedin.com lnkd.in instagram.com instagr.am facebook.com fb.com "
    "fb.me m.facebook.com youtube.com youtu.be m.youtube.com datacamp.com t.me telegram.me "
    "discord.gg discord.com twitter.com x.com"
).split()


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(1))


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _authority(u: Column) -> Column:
    return F.regexp_extract(u, _SCHEME + r"//([^/?#]*)", 1)


def hostname(u: Column) -> Column:
    return F.lower(F.regexp_extract(_authority(u), r"^(?:.*@)?([^:]*)", 1))


def url_port(u: Column) -> Column:
    return F.regexp_extract(_authority(u), r":([0-9]+)$", 1)


def url_path(u: Column) -> Column:
    """Path without query, fragment and the parameters of its last part."""
    path = F.regexp_extract(u, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def canonical_url(u: Column) -> Column:
    """One spelling per page: no fragment, trailing marks or doubled slashes."""
    u = F.regexp_replace(u, INVISIBLE_END, "")
    u = F.regexp_replace(u, r"[.,;:!?)\"']+$", "")
    u = F.regexp_replace(u, r"#.*$", "")
    scheme, port, query = url_scheme(u), url_port(u), url_query(u)
    path = F.regexp_replace(F.regexp_replace(url_path(u), r"/+", "/"), r"/$", "")
    return F.concat(
        F.when(scheme == "", F.lit("https")).otherwise(scheme),
        F.lit("://"),
        hostname(u),
        F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def url_host(u: Column, *, strip_characters: bool = False) -> Column:
    """Host without a leading ``www.``.

    ``strip_characters`` reproduces the reference's rule, which strips any
    leading ``w`` and ``.`` characters (``worldwide.org`` -> ``orldwide.org``).
    """
    host = hostname(u)
    if strip_characters:
        return F.regexp_replace(host, r"^[w.]+", "")
    return F.regexp_replace(host, r"^www\.", "")


def link_domain(u: Column) -> Column:
    """Domain of a shared link; a link that has none stands for itself."""
    found = F.regexp_extract(u, r"^(?:https?://)?(?:www\.)?([^/]+)", 1)
    return F.when(found == "", u).otherwise(found)


def crawl_skip(u: Column, covered_hosts=(), *, strip_characters: bool = False) -> Column:
    """True for blocked hosts, hosts covered elsewhere, binaries, plumbing paths."""
    host, path = url_host(u, strip_characters=strip_characters), F.lower(url_path(u))
    rules = [host.isin(*SKIP_HOSTS)]
    if covered_hosts:
        rules.append(host.isin(*covered_hosts))
    rules += [F.endswith(host, F.lit("." + h)) for h in SKIP_HOSTS]
    rules += [F.endswith(path, F.lit(e)) for e in SKIP_EXTENSIONS]
    rules += [F.contains(path, F.lit(p)) for p in SKIP_PATH_PARTS]
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def hrefs(page: Column) -> Column:
    """Anchor targets of a page, trimmed."""
    found = F.regexp_extract_all(
        page, F.lit(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)
    )
    return F.transform(found, strip)


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of ``href`` seen on page ``base``."""
    site = F.concat(url_scheme(base), F.lit("://"), _authority(base))
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.rlike("^//"), F.concat(url_scheme(base), F.lit(":"), href))
        .when(href.rlike("^/"), F.concat(site, href))
        .when(href.rlike(r"^\?"), F.concat(site, url_path(base), href))
        .otherwise(F.concat(site, folder, href))
    )


def page_links(page: Column, base: Column, covered_hosts=()) -> Column:
    """Distinct canonical links of a page that stay on its host."""
    usable = F.filter(
        hrefs(page), lambda h: (h != "") & ~h.rlike("^(mailto:|tel:|javascript:|#)")
    )
    canon = F.transform(usable, lambda h: canonical_url(resolve(base, h)))
    own = F.filter(canon, lambda u: (url_host(u) == url_host(base)) & ~crawl_skip(u, covered_hosts))
    return F.array_distinct(own)


# fixed values: the entity names of the pages at hand, for callers that stay in the JVM
COMMON_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
    ("&middot;", "·"),
    ("&bull;", "•"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&euro;", "€"),
    ("&#8217;", "’"),
    ("&amp;", "&"),
)


def unescape_common(c: Column) -> Column:
    """Decode the common entities inside the JVM, ``&amp;`` last."""
    for name, char in COMMON_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


@F.pandas_udf(StringType())
def unescape_all(s: pd.Series) -> pd.Series:
    """Decode every HTML entity."""
    return s.map(lambda x: x if x is None else html.unescape(x))


def strip_html(page: Column, *, unescape=unescape_all) -> Column:
    """Visible text: no scripts or styles, a line break per tag, one blank line."""
    for tag in ("script", "style", "iframe", "noscript"):
        page = F.regexp_replace(page, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    page = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    page = F.regexp_replace(page, r"<[!/A-Za-z][^>]*>", "\n")
    page = unescape(page)
    page = F.regexp_replace(page, r"\r\n?", "\n")
    page = F.regexp_replace(page, r"[ \t\f\x{00a0}]+\n", "\n")
    page = F.regexp_replace(page, r"\n{3,}", "\n\n")
    return strip(page)


def html_title(page: Column, *, unescape=unescape_all) -> Column:
    return strip(unescape(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))
