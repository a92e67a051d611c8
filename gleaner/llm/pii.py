"""Operator 4, personal data: patterns propose, checksums confirm, context adjusts (DataFrame only).

Every detector proposes the leftmost non-overlapping matches of its pattern, validators confirm
them (a match that fails is dropped, without another try inside it), and its score is a prior plus
what a passed checksum and context words nearby add. Nearby are the ``NEAR`` code points before and
after a match, as far as the matches next to it; context words count where they begin a word ("tel" is
not in "hotel"). The base kinds (email, ip, card, phone) always
stay; the further kinds stay when the score reaches ``threshold``: an iban by mod-97 alone, national
numbers, dates of birth and secrets (long runs of letters and digits) only beside their words.

Positions come from splitting the text at the same pattern: a match begins where the gaps and
matches before it end. Running lengths are folded over blocks of ``FOLD`` matches, so the work is
in proportion to a text's matches. The patterns are stated with possessive loops, which match the
same strings as the plain ones (tested) but neither recurse per repetition nor rescan long runs, so
very long texts are safe.

Defined results: null or empty text has no spans; repeated rows are judged each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: str
    guard: str
    check: str = ""
    prior: float = 1.0
    context: tuple[str, ...] = ()
    #: What may not stand right before or after a match.
    border: str = ""
    #: Whether the check is a checksum, which adds to the score.
    sums: bool = False


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DATE = "(?:18|19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
BASE = (
    Detector("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", context=("mail", "contact")),
    Detector("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "octets", context=("ip", "host", "server")),
    Detector("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "luhn", context=("card", "visa", "credit"), sums=True),
    Detector("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone", context=("phone", "call", "tel")),
)
MORE = (
    Detector("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "mod97", 0.3, ("iban", "account", "konto"), "[A-Za-z0-9]", True),
    Detector("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "", 0.3, ("ssn", "social security"), "[0-9-]"),
    Detector("birth", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "date", 0.3, ("born", "birth", "geboren", "nacid", "naissance"), "[0-9-]"),
    Detector("secret", r"[A-Za-z0-9+/_-]{20,}+", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}", "mixed", 0.3, ("token", "secret", "passw", "api key", "api_key", "apikey", "bearer", "credential")),
)
#: Code points before and after a match in which context words count, what they and a checksum add;
#: matches whose lengths are summed in one go.
NEAR, CONTEXT, CHECKED, FOLD = 40, 0.3, 0.4, 256


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _starts(sizes: Column) -> Column:
    """array<struct<gap, size>> to the place of each match, one block of them at a time."""

    def step(acc, x):
        at = acc["at"] + x["gap"]
        return F.struct((at + x["size"]).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def block(acc, b):
        inner = F.aggregate(b, F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("out")), step)
        return _with(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def fold(all_):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda i: F.slice(all_, i * FOLD + 1, F.lit(FOLD)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.when(F.size(all_) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["out"])))

    return _with(sizes, fold)


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before, after, alone>>: all matches with their code-point spans, end
    exclusive, what is near them, and whether no other match touches them."""
    split = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("f"))

    def spans(x):
        sizes = F.transform(x["f"], lambda m, i: F.struct(F.length(F.get(x["g"], i)).alias("gap"), F.length(m).alias("size")))

        def placed(at):
            return F.transform(
                x["f"],
                lambda m, i: F.struct(
                    F.get(at, i).alias("s"), (F.get(at, i) + F.length(m)).alias("e"), m.alias("m"),
                    F.right(F.get(x["g"], i), F.lit(NEAR)).alias("before"), F.left(F.get(x["g"], i + 1), F.lit(NEAR)).alias("after"),
                    (((i == 0) | (F.get(x["g"], i) != "")) & ((i == F.size(x["f"]) - 1) | (F.get(x["g"], i + 1) != ""))).alias("alone"),
                ),
            )

        return _with(_starts(sizes), placed)

    return _with(split, spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (lambda d: F.when((n - i) % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.coalesce(F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0, F.lit(False))


def mod97(text: Column) -> Column:
    """Whether an IBAN without spaces passes its check."""
    moved = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    value = F.aggregate(
        F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)),
        F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97,
    )
    return F.length(text).between(15, 34) & (value == 1)


def _confirmed(d: Detector, x: Column) -> Column:
    m = x["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    passed = {
        "": F.lit(True),
        "octets": m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"),
        "luhn": F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(8, 15),
        "mod97": mod97(F.replace(m, F.lit(" "), F.lit(""))),
        "date": m.rlike(f"^{_DATE}$"),
        "mixed": m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    }[d.check]
    if not d.border:
        return passed
    return passed & x["alone"] & ~x["before"].rlike(rf"{d.border}\z") & ~x["after"].rlike(rf"\A{d.border}")


def _begun(words: tuple[str, ...]) -> str:
    """A pattern of lower-cased words that begin one: neither in the middle of a word nor right after a digit."""
    return f"(^|[^a-z0-9])({'|'.join(words)})"


def _score(d: Detector, x: Column) -> Column:
    around = lower_ascii(F.concat(x["before"], F.lit("\n"), x["after"]))
    near = around.rlike(_begun(d.context)) if d.context else F.lit(False)
    return F.least(F.lit(1.0), F.lit(d.prior + (CHECKED if d.sums else 0.0)) + F.when(near, F.lit(CONTEXT)).otherwise(F.lit(0.0)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, more=MORE, threshold: float = 0.6) -> DataFrame:
    """One row per document: ``doc_id`` and one array<struct<s, e, score>> column per kind."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    empty = F.array().cast("array<struct<s:int,e:int,score:double>>")

    def spans_of(d: Detector) -> Column:
        kept = F.filter(find_all(text, d.pattern), lambda x: _confirmed(d, x))
        spans = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _score(d, x).alias("score")))
        if d in more:
            spans = F.filter(spans, lambda x: x["score"] >= threshold)
        guard = text.contains(d.guard) if d.guard == "@" else text.rlike(d.guard)
        return F.when(guard, spans).otherwise(empty).alias(d.kind)

    columns = [spans_of(d) for d in (*base, *more)]
    return rows.select("doc_id", *columns)


def _joined(kinds: list[str]) -> Column:
    def spans(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    every = F.concat(*map(spans, kinds))
    return F.array_join(every, ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """The contract's counts, digest of base spans and list of all spans."""
    base, every = [d.kind for d in BASE], [d.kind for d in (*BASE, *MORE)]
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
    )


def _sql_spans(kind: str, pattern: str, valid: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT doc_id, text, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM t),
{kind}_p AS (
  SELECT doc_id, text, list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::BIGINT, 'm': m[i], 'b': right(g[i], {NEAR}), 'a': left(g[i + 1], {NEAR}), 'o': (i = 1 OR g[i] <> '') AND (i = len(m) OR g[i + 1] <> '')}}) AS x FROM {kind}_m),
{kind} AS (SELECT doc_id, list_transform(list_filter(x, lambda y: {valid}), lambda y: '{kind}:' || y.s || ':' || (y.s + length(y.m))) AS v FROM {kind}_p)"""


_DIGITS = "regexp_replace(y.m, '[^0-9]', '', 'g')"
_LUHN = f"""CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN list_sum(list_transform(range(1, length({_DIGITS}) + 1),
  lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT WHEN {_DIGITS}[i]::INT > 4 THEN {_DIGITS}[i]::INT * 2 - 9 ELSE {_DIGITS}[i]::INT * 2 END)) % 10 = 0 ELSE false END"""
_IBAN = "replace(y.m, ' ', '')"
_MOD97 = f"""length({_IBAN}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({_IBAN}[5:] || {_IBAN}[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"""


def _sql_near(kind: str) -> str:
    words = _begun(next(d for d in MORE if d.kind == kind).context)
    return f"regexp_matches(translate(y.b || chr(10) || y.a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}')"


def _sql_border(border: str) -> str:
    return f"y.o AND NOT regexp_matches(right(y.b, 1), '{border}') AND NOT regexp_matches(left(y.a, 1), '{border}')"


_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", f"regexp_full_match(y.m, '{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", f"{_MOD97} AND {_sql_border('[A-Za-z0-9]')}"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{_sql_near('ssn')} AND {_sql_border('[0-9-]')}"),
    ("birth", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", f"regexp_full_match(y.m, '{_DATE}') AND {_sql_near('birth')} AND {_sql_border('[0-9-]')}"),
    ("secret", r"[A-Za-z0-9+/_-]{20,}", f"regexp_matches(y.m, '[0-9]') AND regexp_matches(y.m, '[A-Za-z]') AND {_sql_near('secret')}"),
)
_ALL = "list_concat(list_concat(list_concat(email.v, ip.v), list_concat(card.v, phone.v)), list_concat(list_concat(iban.v, ssn.v), list_concat(birth.v, secret.v)))"

SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(_sql_spans(*x) for x in _KINDS)
    + f"""
SELECT t.doc_id, len(email.v)::BIGINT AS n_email, len(ip.v)::BIGINT AS n_ip, len(card.v)::BIGINT AS n_card, len(phone.v)::BIGINT AS n_phone,
       sha256(list_aggregate(list_concat(list_concat(email.v, ip.v), list_concat(card.v, phone.v)) || ['']::VARCHAR[], 'string_agg', ',')[:-2]) AS base_sha256,
       list_aggregate({_ALL} || ['']::VARCHAR[], 'string_agg', ',')[:-2] AS spans
FROM t {" ".join(f"JOIN {kind} USING (doc_id)" for kind, _, _ in _KINDS)}
"""
)
