"""URL parts and 52 lexical features as built-in expressions.

The parts follow the usual split of a URL without percent-decoding: a missing scheme reads as ``http``, tabs and
line ends inside vanish, and the host ends the user part at the last ``@``. Unbalanced brackets, brackets around anything
but an IPv6 (or later) address, and characters that normalise to a delimiter in the network part empty every part.
All features are doubles and never null; a null URL is the empty string.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .suffixes import Rules, with_suffix

# Word lists, lists of endings and shorteners that the features are defined by.
KEYWORDS = ("account", "admin", "alert", "auth", "bank", "billing", "confirm", "credential", "customer", "ebayisapi", "expire", "invoice", "limited", "live", "lock", "login", "logon", "mail", "manage", "password", "pay", "recover", "register", "secure", "security", "signin", "submit", "support", "suspend", "unlock", "update", "user", "verify", "wallet", "webscr", "websrc")
BRANDS = ("adobe", "amazon", "americanexpress", "apple", "att", "bankofamerica", "binance", "bradesco", "chase", "citi", "coinbase", "correos", "dhl", "dropbox", "ebay", "facebook", "fedex", "google", "hsbc", "icloud", "instagram", "itau", "linkedin", "metamask", "microsoft", "netflix", "office365", "outlook", "paypal", "roblox", "santander", "steam", "telegram", "tiktok", "usps", "wellsfargo", "whatsapp", "yahoo")
COMMON_TLDS = ("com", "org", "net", "edu", "gov", "uk", "de", "jp", "fr", "au", "ru", "br", "it", "cn", "es", "nl", "ca", "in", "co", "io")
ABUSED_TLDS = ("tk", "ml", "ga", "cf", "gq", "xyz", "top", "buzz", "click", "link", "work", "live", "icu", "cyou", "rest", "fit", "gdn", "loan", "men", "date", "racing", "stream", "download", "review", "country", "kim")
SHORTENERS = ("bit.ly", "goo.gl", "t.co", "tinyurl.com", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "cutt.ly", "shorturl.at", "rb.gy", "tiny.cc", "rebrand.ly", "s.id", "t.ly", "short.io", "lnkd.in")
SCRIPT_ENDINGS = ("php", "asp", "aspx", "jsp", "cgi", "pl", "py")
ARCHIVE_ENDINGS = ("zip", "rar", "7z", "gz", "tar", "exe", "msi", "apk", "scr")
TEMPLATE = r"(?d)^https://www\.[^/?#]+/?$"

def _class(of, base: str = "", category: str = "") -> str:
    """The inside of a character class: ``base`` and, by rule, what ``of`` holds for outside the base's category."""
    found = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and of(chr(c)) and unicodedata.category(chr(c)) != category]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return base + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


@cache
def digits() -> str:
    return _class(str.isdigit, r"\p{Nd}", "Nd")


@cache
def uppers() -> str:
    return _class(str.isupper, r"\p{Lu}", "Lu")


@cache
def unsafe_in_networks() -> str:
    """Characters that turn into a delimiter of a URL's parts when they are normalised."""
    return _class(lambda c: c not in "/?#@:" and any(x in unicodedata.normalize("NFKC", c) for x in "/?#@:"))


def _address() -> str:
    """A pattern of what may stand in a host's brackets: an IPv6 address with or without a scope, or a later version's."""
    h, octet = "[0-9A-Fa-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    last = f"(?:{h}:{h}|{octet}(?:\\.{octet}){{3}})"
    forms = [f"(?:{h}:){{6}}{last}"]
    for left in range(8):
        head = f"(?:(?:{h}:){{0,{left - 1}}}{h})?" if left else ""
        tail = f"(?:{h}:){{{5 - left}}}{last}" if left < 5 else last if left == 5 else h if left == 6 else ""
        forms.append(f"{head}::{tail}")
    return f"(?:(?:{'|'.join(forms)})(?:%[^%]+)?|v[a-fA-F0-9]+\\..+)"


_ADDRESS = _address()


#: What counts as white space at the ends of a URL.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(url: Column) -> Column:
    return F.btrim(F.coalesce(url, F.lit("")), F.lit(BLANKS))


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with u, scheme, netloc, host, port, username, path, query and fragment."""
    df = df.withColumn("u", stripped(F.col(url_col)))
    full = F.when(F.col("u").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), F.col("u")).otherwise(F.concat(F.lit("http://"), F.col("u")))
    full = F.translate(full, "\t\r\n", "")
    # In steps: what several columns use is worked out once, and no step leaves the generated code.
    after = lambda whole, part: F.substring(F.col(whole), F.length(F.col(part)) + 2, F.length(F.col(whole)))
    df = df.withColumn("_full", full).withColumn("_scheme", F.substring_index("_full", "://", 1))
    df = df.withColumn("_rest", F.substring(F.col("_full"), F.length("_scheme") + 4, F.length("_full"))).withColumn("_plain", F.substring_index("_rest", "#", 1))
    df = df.withColumn("_place", F.substring_index("_plain", "?", 1)).withColumn("_net", F.substring_index("_place", "/", 1))
    # Brackets and characters beyond ASCII are rare; only rows that have them pay for their checks.
    opens, closes = F.contains("_net", F.lit("[")), F.contains("_net", F.lit("]"))
    inside = F.substring_index(F.regexp_extract("_net", r"(?s)^[^\[]*\[(.*)$", 1), "]", 1)
    brackets = F.when(opens & closes, inside.rlike(f"(?s)^{_ADDRESS}\\z")).otherwise(opens == closes)
    unsafe = F.when(F.octet_length("_net") > F.length("_net"), F.col("_net").rlike(f"[{unsafe_in_networks()}]")).otherwise(False)
    df = df.withColumn("_good", brackets & ~unsafe)
    good = lambda c: F.when(F.col("_good"), c).otherwise("")
    df = df.withColumns({
        "scheme": good(F.lower("_scheme")), "netloc": good(F.col("_net")), "path": good(F.substring(F.col("_place"), F.length("_net") + 1, F.length("_place"))),
        "query": good(after("_plain", "_place")), "fragment": good(after("_rest", "_plain")),
    })
    df = df.withColumn("_host", F.substring_index("netloc", "@", -1)).withColumn("_user", F.substring(F.col("netloc"), F.lit(1), F.greatest(F.length("netloc") - F.length("_host") - 1, F.lit(0))))
    boxed = F.contains("_host", F.lit("["))
    box = lambda k: F.regexp_extract("_host", r"(?s)^([^\[]*\[([^\]]*)\]?[^:]*)", k)
    df = df.withColumn("_name", F.when(boxed, box(1)).otherwise(F.substring_index("_host", ":", 1)))
    df = df.withColumns({"username": F.substring_index("_user", ":", 1), "host": F.lower(F.when(boxed, box(2)).otherwise(F.col("_name"))), "_port": after("_host", "_name")})
    number = F.when(F.col("_port").rlike("^[0-9]{1,9}$"), F.col("_port").try_cast("int"))
    return df.withColumn("port", F.when(number <= 65535, number)).drop("_full", "_scheme", "_rest", "_plain", "_place", "_net", "_good", "_host", "_user", "_name", "_port")


def count_of(s: Column, char: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))).cast("double")


def class_count(s: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{inside}]", "")).cast("double")


def kind_count(s: Column, ascii_: str, any_: str) -> Column:
    """Characters of a class: strings without others than ASCII are matched against its ASCII part."""
    return F.when(F.octet_length(s) == F.length(s), class_count(s, ascii_)).otherwise(class_count(s, any_))


def entropy(s: Column) -> Column:
    """Bits of the distribution of characters; 0 for the empty string."""
    ordered = F.array_join(F.sort_array(F.split(s, "")), "")  # array_sort would call its comparison row by row
    n = F.length(s).cast("double")
    alike = F.transform(F.regexp_extract_all(ordered, F.lit(r"((?s)(.)\2*)"), F.lit(1)), lambda r: F.length(r).cast("double"))
    bits = F.log2(n) - F.aggregate(alike, F.lit(0.0), lambda a, k: a + k * F.log2(k)) / n
    return F.when(F.length(s) > 0, F.greatest(bits, F.lit(0.0))).otherwise(0.0)


def longest(s: Column, pattern: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(pattern), 1), F.length)), F.lit(0)).cast("double")


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, "[^a-z0-9]+"), lambda t: t != "")


def among(words: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda t: t.isin(*known))).cast("double")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def with_features(df: DataFrame, url_col: str = "url", rules: Rules | None = None) -> DataFrame:
    """``df`` with the parts, the registrable domain and the features of :data:`FEATURES`."""
    df = with_suffix(with_parts(df, url_col), "host", rules)
    u, d, rd = F.col("u"), F.col("label"), F.col("registrable")
    n, dn = F.greatest(F.length(u), F.lit(1)).cast("double"), F.greatest(F.length(d), F.lit(1)).cast("double")
    parts = lambda c, by: F.filter(F.split(c, by), lambda s: s != "")
    # In steps, so that no generated method outgrows what the JVM compiles.
    df = df.withColumns({"_nd": kind_count(u, "0-9", digits()), "_nl": kind_count(u, "a-zA-Z", r"\p{L}"), "_tokens": tokens(F.lower(u)), "_dtokens": tokens(rd), "_segments": parts(F.col("path"), "/")})
    df = df.withColumns({f"{k}_length": F.length(c).cast("double") for k, c in (("url", u), ("domain", F.col("host")), ("subdomain", F.col("subdomain")), ("path", F.col("path")), ("query", F.col("query")), ("fragment", F.col("fragment")))})
    df = df.withColumns({
        "path_depth": F.regexp_count("path", F.lit("[^/]+")).cast("double"), "n_query_params": F.regexp_count("query", F.lit("[^&]+")).cast("double"),
        "digit_ratio": F.col("_nd") / n, "letter_ratio": F.col("_nl") / n, "special_ratio": (n - F.col("_nd") - F.col("_nl")) / n, "upper_ratio": kind_count(u, "A-Z", uppers()) / n, "entropy_url": entropy(u),
    })
    df = df.withColumns({f"n_{k}": count_of(u, c) for k, c in (("dots", "."), ("hyphens", "-"), ("underscores", "_"), ("slashes", "/"), ("equals", "="), ("ampersands", "&"), ("at", "@"), ("tilde", "~"), ("plus", "+"), ("commas", ","))})
    df = df.withColumns({
        "n_hex_escapes": F.regexp_count(u, F.lit("%[0-9a-fA-F]{2}")).cast("double"), "entropy_domain": entropy(d), "domain_digit_ratio": class_count(d, digits()) / dn, "domain_hyphen_count": count_of(d, "-"),
        "domain_vowel_ratio": F.coalesce(class_count(d, "aeiou") / F.nullif(class_count(d, r"\p{L}"), F.lit(0.0)), F.lit(0.0)),
        "domain_max_consonant_run": longest(d, r"([\p{L}&&[^aeiou]]+)"), "domain_max_repeat_run": longest(d, r"((?s)(.)\2*)"), "domain_digit_group_count": F.regexp_count(d, F.lit(r"\p{Nd}+")).cast("double"),
        "domain_token_count": F.size("_dtokens").cast("double"), "domain_longest_token": F.coalesce(F.array_max(F.transform("_dtokens", F.length)), F.lit(0)).cast("double"), "n_subdomains": F.regexp_count("subdomain", F.lit("[^.]+")).cast("double"),
    })
    ending = F.lower(F.coalesce(F.substring_index(F.element_at(F.when(F.size("_segments") > 0, F.col("_segments")), -1), ".", -1), F.lit("")))
    outside = tokens(F.lower(F.concat_ws(" ", "subdomain", "path", "query")))
    return df.withColumns({
        "has_www": flag((F.col("subdomain") == "www") | F.col("subdomain").startswith("www.")), "is_ip_domain": flag(F.col("host").rlike(r"^\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}$")), "has_punycode": flag(F.contains("host", F.lit("xn--"))),
        "tld_length": F.length("suffix").cast("double"), "tld_is_common": flag(F.col("suffix").isin(*COMMON_TLDS)), "tld_is_abused": flag(F.substring_index("suffix", ".", -1).isin(*ABUSED_TLDS)), "is_shortener": flag(rd.isin(*SHORTENERS)),
        "is_https": flag(F.col("scheme") == "https"), "has_port": flag(F.col("port").isNotNull()), "has_nonstandard_port": flag(~F.col("port").isin(80, 443)), "has_userinfo": flag(F.col("username") != ""),
        "has_at_symbol": flag(F.contains(u, F.lit("@"))), "double_slash_in_path": flag(F.contains("path", F.lit("//"))), "suspicious_keyword_count": among(F.col("_tokens"), KEYWORDS), "brand_token_count": among(F.col("_tokens"), BRANDS),
        "brand_outside_domain": F.when(among(F.col("_dtokens"), BRANDS) > 0, 0.0).otherwise(among(outside, BRANDS)), "has_script_ext": flag(ending.isin(*SCRIPT_ENDINGS)), "has_archive_ext": flag(ending.isin(*ARCHIVE_ENDINGS)),
    }).drop("_nd", "_nl", "_tokens", "_dtokens", "_segments")


LENGTHS = ["url_length", "domain_length", "subdomain_length", "path_length", "query_length", "fragment_length", "path_depth", "n_query_params"]
RATIOS = ["digit_ratio", "letter_ratio", "special_ratio", "upper_ratio", "entropy_url"]
COUNTS = ["n_dots", "n_hyphens", "n_underscores", "n_slashes", "n_equals", "n_ampersands", "n_at", "n_tilde", "n_plus", "n_commas", "n_hex_escapes"]
SHAPE = ["entropy_domain", "domain_digit_ratio", "domain_hyphen_count", "domain_vowel_ratio", "domain_max_consonant_run", "domain_max_repeat_run", "domain_digit_group_count", "domain_token_count", "domain_longest_token", "n_subdomains"]
FLAGS = ["has_www", "is_ip_domain", "has_punycode", "tld_length", "tld_is_common", "tld_is_abused", "is_shortener", "is_https", "has_port", "has_nonstandard_port", "has_userinfo"]
WORDS = ["has_at_symbol", "double_slash_in_path", "suspicious_keyword_count", "brand_token_count", "brand_outside_domain", "has_script_ext", "has_archive_ext"]
#: The fixed order of the feature vector.
FEATURES = LENGTHS + RATIOS + COUNTS + SHAPE + FLAGS + WORDS
PATH_SHAPE = ["path_length", "query_length", "path_depth", "n_query_params", "n_slashes", "n_equals", "n_ampersands", "fragment_length"]


def surt(domain: Column) -> Column:
    """Labels in reverse order, joined by commas: the sort key of a crawl index."""
    return F.array_join(F.reverse(F.split(F.trim(F.lower(domain), F.lit(".")), "[.]")), ",")
