"""Guards, placeholders, routing and other row-local functions, as Catalyst expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases (letters and digits only) that mark a prompt injection.
INJECTION = ("systemoverride", "ignorepreviousinstructions", "disregardinstructions", "bypassconstraints", "forgetall", "printyour")
#: A run of the base64 alphabet this long with more than this entropy (bits a byte) is smuggling.
SMUGGLED_RUN, SMUGGLED_BITS = 40, 5.8
#: Placeholder prefixes by part of the rule id, in order of precedence, then by category.
PREFIX_BY_RULE = (
    ("EMAIL", ("EMAIL",)), ("NAME", ("PERSON", "NAME")), ("PHONE", ("PHONE",)), ("AFM", ("AFM",)), ("AMKA", ("AMKA",)), ("IBAN", ("IBAN", "BANK")),
    ("CREDIT_CARD", ("CARD",)), ("SSN", ("SSN",)), ("PASSPORT", ("PASSPORT",)), ("IP", ("IP_ADDRESS", "IPV4", "IPV6")),
)
PREFIX_BY_CATEGORY = {
    "IndividualName": "NAME", "IdentificationNumber": "ID", "FinancialData": "FINANCIAL", "ContactInfo": "CONTACT", "InternalAsset": "ASSET",
    "HighConfidenceAi": "AI_REDACTED", "PotentialHeuristic": "HEURISTIC", "Organization": "ORG", "Location": "LOCATION", "Other": "TOKEN",
}
PRIORITY = {"AuditOnly": 1, "Mask": 2, "Redact": 3, "Block": 4}
#: Characters that are never seen (controls but tab, line feed and return; zero-width and bidi marks).
INVISIBLE = "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F-\\u009F\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\uFEFF]"


def visible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def folded(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", ""))


def injection_hit(text: Column) -> Column:
    return folded(text).rlike("|".join(INJECTION))


def entropy(run: Column) -> Column:
    """Shannon entropy of an ASCII string in bits a character."""
    chars = F.split(run, "")
    n = F.length(run).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(run, c, F.lit(""))))
    return F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - F.when(c > 0, (c / n) * F.log2(c / n)).otherwise(0.0))


def entropy_hit(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9+/=]{{{SMUGGLED_RUN + 1},}}"), 0)
    return F.exists(runs, lambda r: entropy(r) > SMUGGLED_BITS)


def guard_status(text: Column, check: Column | None = None, classifier: Column | None = None) -> Column:
    """ok, injection, smuggling or classifier; a guarded row keeps its place with this status.

    classifier is a hook for a model's verdict (a boolean column); null, where the model could not be asked, is a refusal.
    """
    status = F.when(injection_hit(text), "injection").when(entropy_hit(text), "smuggling")
    if classifier is not None:
        status = status.when(F.coalesce(classifier, F.lit(True)), "classifier")
    status = status.otherwise("ok")
    return status if check is None else F.when(check, status).otherwise("ok")


def guard_by_role(role: Column, text: Column) -> Column:
    """In a chat only the user's turns are guarded."""
    return guard_status(text, F.lower(role) == "user")


def standalone_word(text: Column, sub: str) -> Column:
    """Is sub in text with no letter or digit on either side?"""
    if not sub:
        return F.lit(False)
    edge = r"[\p{IsAlphabetic}\p{N}]"
    return text.rlike(f"(?<!{edge})" + re.sub(r"([^\w\s])", r"\\\1", sub) + f"(?!{edge})")


def priority(action: Column) -> Column:
    return reduce(lambda acc, x: acc.when(action == x[0], x[1]), list(PRIORITY.items())[1:], F.when(action == "AuditOnly", 1))


def action_of(prio: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in PRIORITY]), prio.cast("int"))


def combine_actions(a: Column, b: Column) -> Column:
    return action_of(F.greatest(priority(a), priority(b)))


def placeholder_prefix(rule_id: Column, category: Column) -> Column:
    up = F.upper(rule_id)
    out = None
    for prefix, parts in PREFIX_BY_RULE:
        hit = reduce(lambda a, b: a | b, [F.contains(up, F.lit(p)) for p in parts])
        out = F.when(hit, prefix) if out is None else out.when(hit, prefix)
    for name, prefix in PREFIX_BY_CATEGORY.items():
        out = out.when(category == name, prefix)
    return out.otherwise("TOKEN")


def placeholder(rule_id: Column, category: Column, number: Column) -> Column:
    return F.concat(F.lit("["), placeholder_prefix(rule_id, category), F.lit("_"), number.cast("string"), F.lit("]"))


def route_model(model: Column, target: Column | None = None) -> Column:
    """custom, anthropic, local or default: an explicit target wins, then the model's name."""
    m = F.lower(model)
    name = F.substring_index(m, "/", -1)
    local = reduce(lambda a, b: a | b, [name.startswith(p) for p in ("llama", "mistral", "phi", "gemma", "qwen")])
    out = F.when(m.startswith("claude"), "anthropic").when(local, "local").otherwise("default")
    return out if target is None else F.when(target.isNotNull(), "custom").otherwise(out)


def resolve_key(target: Column, explicit: Column, ambient: Column) -> Column:
    """A custom target never gets the ambient key."""
    return F.when(target.isNotNull(), F.coalesce(explicit, F.lit(""))).otherwise(F.coalesce(explicit, ambient, F.lit("local")))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def _number(digits: Column, base: int) -> Column:
    return F.conv(digits, base, 10).cast("decimal(20,0)")


def _ipv4(host: Column) -> Column:
    """The number of an address of one to four decimal, octal or hexadecimal parts; -1 for one that is none, null for a name."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")

    def value(p: Column) -> Column:
        return (
            F.when(p.rlike("^0x0*[0-9a-f]{0,9}$"), _number(F.concat(F.lit("0"), F.substring(p, 3, 1 << 30)), 16))
            .when(p.rlike("^00*[0-7]{0,12}$"), _number(p, 8)).when(p.rlike("^[1-9][0-9]{0,10}$"), _number(p, 10))
        )

    def of(v: Column) -> Column:
        n = F.size(v)
        heads, last = F.slice(v, F.lit(1), n - 1), F.element_at(v, -1)
        fine = (n <= 4) & ~F.exists(v, lambda x: x.isNull()) & ~F.exists(heads, lambda x: x > 255) & (last.cast("double") < F.pow(F.lit(256.0), 5 - n))
        whole = F.aggregate(heads, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long")) * F.pow(F.lit(256.0), 5 - n).cast("long") + last.cast("long")
        return F.when(F.coalesce(fine, F.lit(False)), whole).otherwise(F.lit(-1).cast("long"))

    return F.when(F.element_at(parts, -1).rlike("^([0-9]+|0x[0-9a-f]*)$"), _let(F.transform(parts, value), of))


def _ipv6(host: Column) -> Column:
    """The eight groups of an address, null for one that is none."""
    tail = F.regexp_extract(host, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    plain = F.when(tail == "", host).otherwise(
        _let(_ipv4(tail), lambda n: F.concat(F.substring(host, F.lit(1), F.length(host) - F.length(tail)), F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536))))
    )

    def groups(text: Column) -> Column:
        sides = F.transform(F.split(text, "::"), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":")))

        def filled(s: Column) -> Column:
            known = F.aggregate(s, F.lit(0), lambda acc, x: acc + F.size(x))
            whole = F.when(F.size(s) == 1, s[0]).when((F.size(s) == 2) & (known < 8), F.concat(s[0], F.array_repeat(F.lit("0"), 8 - known), s[1]))
            return F.when((F.size(whole) == 8) & ~F.exists(whole, lambda g: ~g.rlike("^[0-9a-f]{1,4}$")), F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int")))

        return _let(sides, filled)

    return F.when(host.contains(":"), _let(plain, groups))


def url_verdict(url: Column, production: bool = True, allow_private: bool = False, allowed_hosts: tuple[str, ...] = ()) -> Column:
    """ok, or why a target is refused, from the URL alone (names are not resolved).

    Hosts are read as browsers read them: user names and ports aside, percent-decoded, and addresses in any notation
    (decimal, octal, hexadecimal, shortened, IPv4 inside IPv6) judged by their number.  Metadata endpoints are refused
    everywhere; private ones in production, unless they are listed as allowed.
    """
    clean = F.regexp_replace(F.trim(url), "[\\t\\r\\n]", "")
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*([^/\\?#]*)", 1)
    place = F.lower(F.try_url_decode(F.replace(F.regexp_replace(authority, "^.*@", ""), F.lit("+"), F.lit("%2B"))))

    def judge(x: Column) -> Column:
        host, port, v4, v6 = x["host"], x["port"], x["v4"], x["v6"]
        inner = F.when(F.forall(F.slice(v6, 1, 5), lambda g: g == 0) & v6[5].isin(0, 0xFFFF), v6[6].cast("long") * 65536 + v6[7])
        n = F.coalesce(v4, inner)
        name = host.rlike(r"^(instance-data(\..*)?|.*\.instance-data|(.*\.)?metadata\.google\.internal)$")
        metadata = F.coalesce(F.shiftright(n, 16) == (169 << 8 | 254), F.lit(False)) | F.coalesce(v6[0].bitwiseAND(F.lit(0xFFC0)) == 0xFE80, F.lit(False))
        top = F.shiftright(n, 24)
        private = top.isin(0, 10, 127) | (F.shiftright(n, 20) == (172 << 4 | 1)) | (F.shiftright(n, 16) == (192 << 8 | 168))
        private = F.coalesce(private, F.lit(False)) | F.coalesce(v6[0].bitwiseAND(F.lit(0xFE00)) == 0xFC00, F.lit(False)) | (host == "localhost") | host.endswith(".localhost")
        broken = (host == "") | (v4 == -1) | (host.contains(":") & v6.isNull())
        out = F.when(~scheme.isin("http", "https") | F.coalesce(broken, F.lit(True) & host.isNull()), "scheme").when(name, "metadata")
        listed = F.lit(False)
        if allowed_hosts:
            items = [h.strip().strip("[]").lower() for h in allowed_hosts]
            dotted = F.concat_ws(".", *[F.shiftright(v4, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])
            host = F.when(v4 >= 0, dotted).otherwise(host)
            listed = host.isin(*items) | F.when(port != "", F.concat_ws(":", host, port).isin(*items)).otherwise(F.lit(False))
            out = out.when(~listed, "not allowed")
        out = out.when(metadata, "metadata")
        if production and not allow_private:
            out = out.when(private & ~listed, "private")
        return out.otherwise("ok")

    host = F.regexp_replace(F.regexp_replace(place, r":[0-9]*$", ""), r"[\[\]]", "")
    host = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(host)
    parts = _let(F.coalesce(host, F.lit("")), lambda h: F.struct(h.alias("host"), F.regexp_extract(place, r":([0-9]+)$", 1).alias("port"), F.when(~h.contains(":"), _ipv4(h)).alias("v4"), _ipv6(h).alias("v6")))
    return _let(parts, judge)


def chat_texts(body: Column) -> Column:
    """The texts of a chat body's messages: contents that are strings, or arrays of blocks with a text."""
    plain = F.from_json(body, "messages array<struct<role:string,content:string>>")["messages"]

    def texts(m: Column) -> Column:
        blocks = F.from_json(m["content"], "array<struct<type:string,text:string,content:string>>")
        return F.when(m["content"].startswith("["), F.filter(F.transform(blocks, lambda b: F.coalesce(b["text"], b["content"])), lambda t: t.isNotNull())).otherwise(F.array(m["content"]))

    return F.flatten(F.transform(plain, texts))


def merge_token_maps(left: Column, right: Column) -> Column:
    """The union; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def restore(text: Column, tokens: Column) -> Column:
    """Every key of tokens back to its value in one pass, the longest of those that start first (values are not looked at again)."""
    keys = F.array_sort(F.filter(F.map_keys(tokens), lambda k: k != ""), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(keys, lambda k: F.concat(F.lit(r"\Q"), F.replace(k, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))

    def put(pattern: Column) -> Column:
        gaps, marks = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
        back = F.transform(marks, lambda m: tokens[m])
        return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), back.alias("m")), lambda x: F.array(x["g"], F.coalesce(x["m"], F.lit(""))))), "")

    return F.when(F.coalesce(F.size(keys), F.lit(0)) > 0, _let(F.array_join(quoted, "|"), put)).otherwise(text)


def blank_image(data: Column) -> Column:
    """A redacted image: as many zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), F.octet_length(data)))
