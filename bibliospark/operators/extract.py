"""Cleaning of landed article documents.

Input: ``(seq long, value string)`` - one JSON document per row, ``seq`` the
explicit file order. Output: the same rows with either a clean article
(``CLEAN_COLUMNS``, schema of ``CLEAN_SCHEMA``) or a ``reject_reason``.

Everything is one narrow pass per row, without a shuffle. A document whose authors,
affiliations and keywords have the expected kinds is judged in Arrow batches
(``_plain``). Any other - mistyped there, malformed, outside the limits within which
both JSON parsers agree - is left to the rules in ``validate``: polymorphic
paths are inspected as VARIANT, lists are normalised with higher-order functions,
and the per-author affiliation lookup (J1) runs inside the document's own arrays.
Those are interpreted value by value, several times the cost of the plain form.
A malformed or mistyped record is rejected on its own and never stops the job.

Deviations from the reference, by design: malformed JSON rejects one record
(the reference aborts the file); a JSON-null name part counts as '' (not the
text "None"); non-string affiliation fields and subject abbreviations are
rejected here, where the reference would fail later while loading.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.text import PY_WHITESPACE, norm_title, py_strip
from ..sources.landed import ID_PREFIX, RESPONSE
from ..functions.variant import (
    ARRAY, BOOLEAN, MISSING, NULL, NUMBER, OBJECT, STRING,
    as_array, as_list, id_key, is_object, scalar_text, string_or, truthy, vget, vkind, vkind_leaf,
)

CLEAN_SCHEMA = (
    "seq long, scopus_id string, titre string, resume string, date_publication string, "
    "revue string, doi string, mots_cles array<string>, domaine_recherche string, "
    "auteurs array<struct<scopus_author_id: string, nom_complet: string, orcid: string, "
    "affiliations: array<struct<scopus_affiliation_id: string, nom_institution: string, pays: string>>>>"
)
CLEAN_COLUMNS = ["seq", "scopus_id", "titre", "resume", "date_publication", "revue", "doi",
                 "mots_cles", "domaine_recherche", "auteurs"]

# The coredata keys read into the clean article, in reading order.
CORE_FIELDS = (
    ("scopus_id", "dc:identifier"),
    ("titre", "dc:title"),
    ("resume", "dc:description"),
    ("date_publication", "prism:coverDate"),
    ("revue", "prism:publicationName"),
    ("doi", "prism:doi"),
)


def _first_non_null(arr: Column) -> Column:
    return F.get(F.filter(arr, lambda x: x.isNotNull()), 0)


def _first_match(block: Column, keys: Column, key: Column) -> Column:
    """The first block entry whose id equals ``key`` null-safely (NULL
    when none). A position lookup over the precomputed keys: no filtered copy
    of the block per reference."""
    pos = F.array_position(keys, F.coalesce(key, F.lit("")))
    return F.when(pos > 0, F.element_at(block, pos.cast("int")))


def _empty() -> Column:
    return F.array().cast("array<variant>")


def _c(name: str) -> Column:
    return F.col(name)


class _NotPlain(Exception):
    """A document that the rules of ``validate`` must judge."""


# Documents up to this size cannot reach a limit of the JVM's JSON parser (depth
# 1,000, keys of 50,000 characters); larger ones are walked, and those beyond the
# second are not plain.
_SMALL, _LARGE = 900, 1_000_000
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _whole(text: str) -> int:
    if len(text) > 18:
        raise _NotPlain
    return int(text)


def _real(text: str) -> float:
    if len(text) > 30 or not math.isfinite(x := float(text)):
        raise _NotPlain
    return x


def _constant(text: str):
    raise _NotPlain  # NaN and Infinity are no JSON


_DECODER = json.JSONDecoder(parse_int=_whole, parse_float=_real, parse_constant=_constant)


def _within_limits(x, depth: int = 1) -> None:
    if depth > 200 or isinstance(x, dict) and any(len(k) > 10_000 for k in x):
        raise _NotPlain
    for y in x.values() if isinstance(x, dict) else x:
        if isinstance(y, (dict, list)):
            _within_limits(y, depth + 1)


def _text(x) -> str:
    if x is None:
        return ""
    if type(x) is not str:
        raise _NotPlain
    return x


def _object(x) -> dict:
    """An object; a missing value, null and a string have no keys."""
    if type(x) is dict:
        return x
    _text(x)
    return {}


def _objects(x) -> list[dict]:
    """An object is a list of one, a string of none. A list holds objects alone."""
    if type(x) is dict:
        return [x]
    if type(x) is not list:
        if type(x) is not str:
            raise _NotPlain
        return []
    if any(type(y) is not dict for y in x):
        raise _NotPlain
    return x


def _plain(value: bytes | None):
    """The clean columns behind ``seq`` and the reason for rejection (or None) of a
    document whose authors, affiliations and keywords have the expected kinds; None
    for any other. Authors come as (id, name, orcid, their affiliations)."""
    try:
        if value is None or len(value) > _LARGE:
            return None
        text = value.decode("utf-8")
        doc = _DECODER.decode(text)
        if type(doc) is not dict or "\\u" in text and _SURROGATE.search(text):
            return None
        if len(text) > _SMALL and (len(text) > 50_000 or text.count("{") + text.count("[") > _SMALL):
            _within_limits(doc)
        resp = _object(doc.get(RESPONSE))
        core = _object(resp.get("coredata"))
        reason, fields = None, []
        for _, key in CORE_FIELDS:
            x = core.get(key)
            if type(x) is not str:
                reason = reason or (f"{key} not a string" if x else None)
                x = ""
            fields.append(x.strip(PY_WHITESPACE))
        fields[0] = fields[0].replace(ID_PREFIX, "").strip(PY_WHITESPACE)

        words = resp.get("authkeywords")
        if words and type(words) is not dict:
            reason = reason or "authkeywords not an object"
        words = words.get("author-keyword", "") if type(words) is dict else ""
        if words is None or type(words) in (int, float, bool):
            reason = reason or ("author-keyword null" if words is None else "author-keyword not a list")
            words = ""
        if type(words) is str:
            words = [words]
        else:
            words = [w.get("$", "") for w in _objects(words)]
            if any(type(w) is not str for w in words):
                return None
        kept = [k for w in words if (k := w.strip(PY_WHITESPACE))]

        area = _object(resp.get("subject-areas")).get("subject-area")
        if type(area) is list and area:
            area = area[0]
            if type(area) is not dict:
                reason, area = reason or "first subject-area not an object", None
        domain = area.get("@abbrev", "") if type(area) is dict else ""
        if type(domain) is not str:
            reason, domain = reason or (None if domain is None else "subject abbrev not a string"), ""

        # The first entry of an id; a missing id and null are one
        details: dict = {}
        for b in _objects(resp.get("affiliation", "")):
            entry = tuple(b.get(k, "") for k in ("@id", "affilname", "affiliation-country"))
            for x in entry:
                _text(x)
            details.setdefault(b.get("@id"), entry)
        people = []
        for a in _objects(_object(resp.get("authors")).get("author") or ""):
            ident = a.get("@auid", "")
            refs = [r.get("@id") for r in _objects(a.get("affiliation", ""))]
            if type(ident) is not str or any(r is not None and type(r) is not str for r in refs):
                return None
            name = f"{_text(a.get('ce:given-name'))} {_text(a.get('ce:surname'))}".strip(PY_WHITESPACE)
            _text(a.get("orcid"))
            people.append((ident.strip(PY_WHITESPACE), name, a.get("orcid"), [details[r] for r in refs if r in details]))
        return *fields, kept, domain, people, reason
    except (_NotPlain, ValueError, RecursionError):
        return None


def _lists(rows: list, items) -> pa.Array:
    """The list array whose entries hold as many of ``items`` as those of ``rows``."""
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def _strings(rows: list, names: tuple) -> pa.Array:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in columns], list(names))


_FOUND = [f"_p_{n}" for n in [*CLEAN_COLUMNS[1:], "reject_reason"]]
_EMPTY = ("",) * len(CORE_FIELDS) + ([], "", [], None)


def _plain_batches(batches):
    """(seq, value) with a column ``_plain`` and the clean columns of plain documents."""
    for b in batches:
        if not b.num_rows:
            continue
        seq, value = b.columns
        raw = value.cast(pa.large_binary() if pa.types.is_large_string(value.type) else pa.binary())
        rows = [_plain(v) for v in raw.to_pylist()]
        plain = pa.array([r is not None for r in rows], pa.bool_())
        *fields, words, domain, people, reason = zip(*[r or _EMPTY for r in rows])
        flat = [p for ps in people for p in ps]
        affils = [p[3] for p in flat]
        person = pa.StructArray.from_arrays(
            [*(pa.array([p[k] for p in flat], pa.string()) for k in range(3)),
             _lists(affils, _strings([f for fs in affils for f in fs],
                                     ("scopus_affiliation_id", "nom_institution", "pays")))],
            ["scopus_author_id", "nom_complet", "orcid", "affiliations"])
        yield pa.RecordBatch.from_arrays(
            [seq, value, plain, *(pa.array(f, pa.string()) for f in fields),
             _lists(words, pa.array([w for ws in words for w in ws], pa.string())),
             pa.array(domain, pa.string()), _lists(people, person), pa.array(reason, pa.string())],
            ["seq", "value", "_plain", *_FOUND])


def _with_plain(raw: DataFrame) -> DataFrame:
    """The documents with ``_plain`` and, as ``_p_`` columns, what ``_plain`` found."""
    found = [f.dataType for f in StructType.fromDDL(f"{CLEAN_SCHEMA}, reject_reason string")][1:]
    schema = StructType([raw.schema["seq"], StructField("value", StringType()), StructField("_plain", BooleanType()),
                         *(StructField(n, t) for n, t in zip(_FOUND, found))])
    return raw.select("seq", "value").mapInArrow(_plain_batches, schema)


def validate(raw: DataFrame) -> DataFrame:
    """Parse and clean every document. Returns ``CLEAN_COLUMNS`` plus
    ``reject_reason`` (NULL for accepted records) and the original ``value``.

    Plain documents come done from ``_with_plain``; the stages below are evaluated
    for the others alone.

    Built in stages: each stage materialises values and their JSON kinds as
    columns (or struct fields inside arrays), so every expression references
    small attributes and the plan stays linear in the number of rules."""
    c = _c
    # a repeated key of an object keeps its last value
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = _with_plain(raw)
    judged = ~c("_plain")

    def step(df: DataFrame, values: dict[str, Column]) -> DataFrame:
        return df.withColumns({n: F.when(judged, e) for n, e in values.items()})

    def kinds(df: DataFrame, **values: Column) -> DataFrame:
        return step(step(df, values), {n + "_k": vkind(c(n)) for n in values})

    df = kinds(df, _v=F.try_parse_json(c("value")))
    # P1's walk reads every value by its full path from the root: a step
    # through a non-object gives NULL, exactly as the key-by-key walk does,
    # and no intermediate object (the response, its coredata, the author
    # wrapper) is copied out of the document on the way.
    root = c("_v")
    fields = {f"_f{i}": vget(root, RESPONSE, "coredata", key) for i, (_, key) in enumerate(CORE_FIELDS)}
    df = kinds(df,
               _kc=vget(root, RESPONSE, "authkeywords"),
               _blk=vget(root, RESPONSE, "affiliation"))
    blk, blk_k = c("_blk"), c("_blk_k")
    # independent chains advance together: one projection per dependency level
    df = step(df, {
        **fields,
        "_sa": vget(root, RESPONSE, "subject-areas", "subject-area"),
        "_au": vget(root, RESPONSE, "authors", "author"),
        # the document's affiliation block (J1 lookup table), indexed
        "_b0": F.transform(as_list(blk, blk_k), lambda e, i: F.struct(
            i.alias("idx"), is_object(e).alias("obj"), vget(e, "@id").alias("id"),
            vget(e, "affilname").alias("name"), vget(e, "affiliation-country").alias("ctry"))),
        "_block_bad": blk_k.isin(NULL, NUMBER, BOOLEAN),
    })
    df = step(df, {
        **{n + "_k": vkind_leaf(c(n)) for n in fields},
        **{n + "_k": vkind(c(n)) for n in ["_sa", "_au"]},
        "_b1": F.transform(c("_b0"), lambda b: F.struct(
            b["idx"].alias("idx"), b["obj"].alias("obj"),
            b["id"].alias("id"), vkind_leaf(b["id"]).alias("id_k"),
            b["name"].alias("name"), vkind_leaf(b["name"]).alias("name_k"),
            b["ctry"].alias("ctry"), vkind_leaf(b["ctry"]).alias("ctry_k"))),
    })
    # extract_field keeps only truthy end values
    df = step(df, {
        **{n + "_t": F.coalesce(truthy(c(n), c(n + "_k")), F.lit(False))
           for n in list(fields) + ["_kc", "_sa", "_au"]},
        "_block": F.transform(c("_b1"), lambda b: F.struct(
            b["idx"].alias("idx"), b["obj"].alias("obj"), id_key(b["id"], b["id_k"]).alias("key"),
            (~b["id_k"].isin(MISSING, NULL, STRING) | ~b["name_k"].isin(MISSING, NULL, STRING)
             | ~b["ctry_k"].isin(MISSING, NULL, STRING)).alias("bad"),
            F.struct(string_or(b["id"], b["id_k"], "").alias("scopus_affiliation_id"),
                     string_or(b["name"], b["name_k"], "").alias("nom_institution"),
                     string_or(b["ctry"], b["ctry_k"], "").alias("pays")).alias("det"))),
    })
    sa, sa_k, sa_t = c("_sa"), c("_sa_k"), c("_sa_t")
    au, au_k, au_t = c("_au"), c("_au_k"), c("_au_t")
    df = step(df, {
        "_rk": F.when(c("_kc_t"), vget(c("_kc"), "author-keyword")),
        "_sa_first": F.when(sa_t & (sa_k == ARRAY), F.get(as_array(sa), 0)),
        "_a0": F.when(au_t, as_list(au, au_k)).otherwise(_empty()),
        "_block_bad_idx": F.get(F.filter(c("_block"), lambda e: ~e["obj"]), 0)["idx"],
        # J1 lookup keys: a missing/null id is '' (to_json never gives '') so
        # array_position matches it null-safely; non-objects never match
        "_block_keys": F.transform(c("_block"), lambda e: F.when(e["obj"], F.coalesce(e["key"], F.lit("")))),
    })
    df = step(df, {
        "_rk_k": vkind(c("_rk")),
        "_sa_first_k": vkind(c("_sa_first")),
        "_a1": F.transform(c("_a0"), lambda a: F.struct(
            is_object(a).alias("obj"), vget(a, "@auid").alias("id"), vget(a, "ce:given-name").alias("gn"),
            vget(a, "ce:surname").alias("sn"), vget(a, "orcid").alias("oc"), vget(a, "affiliation").alias("rf"))),
    })
    kct, rk, rk_k = c("_kc_t"), c("_rk"), c("_rk_k")
    df = step(df, {
        "_kw0": F.when(kct & (rk_k != STRING), as_list(rk, rk_k)).otherwise(_empty()),
        "_abbrev": F.when(sa_t & (sa_k == OBJECT), vget(sa, "@abbrev"))
        .when(sa_t & (sa_k == ARRAY) & (c("_sa_first_k") == OBJECT), vget(c("_sa_first"), "@abbrev")),
        "_a2": F.transform(c("_a1"), lambda x: F.struct(
            x["obj"].alias("obj"),
            x["id"].alias("id"), vkind_leaf(x["id"]).alias("id_k"),
            x["gn"].alias("gn"), vkind_leaf(x["gn"]).alias("gn_k"),
            x["sn"].alias("sn"), vkind_leaf(x["sn"]).alias("sn_k"),
            x["oc"].alias("oc"), vkind_leaf(x["oc"]).alias("oc_k"),
            x["rf"].alias("rf"), vkind_leaf(x["rf"]).alias("rf_k"))),
    })
    df = step(df, {
        "_abbrev_k": vkind(c("_abbrev")),
        "_kw1": F.transform(c("_kw0"), lambda it: F.struct(
            is_object(it).alias("obj"), vget(it, "$").alias("d"))),
        "_a3": F.transform(c("_a2"), lambda x: F.struct(
            x["obj"].alias("obj"), x["id"].alias("id"), x["id_k"].alias("id_k"),
            py_strip(F.concat(scalar_text(x["gn"], x["gn_k"]), F.lit(" "),
                              scalar_text(x["sn"], x["sn_k"]))).alias("name"),
            F.when(x["oc_k"] == STRING, F.try_variant_get(x["oc"], "$", "string"))
            .when(~x["oc_k"].isin(MISSING, NULL), F.to_json(x["oc"])).alias("orcid"),
            x["rf_k"].alias("rf_k"),
            F.transform(as_list(x["rf"], x["rf_k"]), lambda r: F.struct(
                is_object(r).alias("obj"), vget(r, "@id").alias("id"))).alias("refs"))),
    })
    df = step(df, {
        "_kw2": F.transform(c("_kw1"), lambda x: F.struct(
            x["obj"].alias("obj"), x["d"].alias("d"), vkind_leaf(x["d"]).alias("dk"))),
        "_a4": F.transform(c("_a3"), lambda x: x.withField(
            "refs", F.transform(x["refs"], lambda r: F.struct(
                r["obj"].alias("obj"), id_key(r["id"], vkind_leaf(r["id"])).alias("key"))))),
    })
    df = step(df, {"_a5": F.transform(c("_a4"), lambda x: x.withField(
        "refs", F.transform(x["refs"], lambda r: F.struct(
            r["obj"].alias("obj"),
            _first_match(c("_block"), c("_block_keys"), r["key"]).alias("m")))))})
    bad_idx, block_bad = c("_block_bad_idx"), c("_block_bad")

    def ref_err(r: Column) -> Column:
        m = r["m"]
        return (F.when(~r["obj"], F.lit("affiliation ref not an object"))
                .when(block_bad, F.lit("document affiliation not a list"))
                .when(bad_idx.isNotNull() & (m.isNull() | (bad_idx < m["idx"])),
                      F.lit("affiliation entry not an object"))
                .when(m.isNotNull() & m["bad"], F.lit("affiliation field not a string")))

    df = step(df, {"_authors": F.transform(c("_a5"), lambda x: F.struct(
        (F.when(~x["obj"], F.lit("author not an object"))
         .when(~x["id_k"].isin(MISSING, STRING), F.lit("author id not a string"))
         .when(x["rf_k"] == NULL, F.lit("author affiliation null"))
         .when(x["rf_k"].isin(NUMBER, BOOLEAN), F.lit("author affiliation not a list"))
         .otherwise(_first_non_null(F.transform(x["refs"], ref_err)))).alias("err"),
        F.coalesce(py_strip(F.try_variant_get(x["id"], "$", "string")), F.lit("")).alias("scopus_author_id"),
        x["name"].alias("nom_complet"),
        x["orcid"].alias("orcid"),
        F.transform(F.filter(x["refs"], lambda r: r["m"].isNotNull()), lambda r: r["m"]["det"]).alias("affiliations")))})

    # rejection rules in the order the reference meets them
    errs: list[Column] = [
        F.when(c("value").isNotNull() & c("_v").isNull(), F.lit("malformed json")),
        F.when(c("_v").isNotNull() & (c("_v_k") != OBJECT), F.lit("top level not an object")),
    ]
    cols: dict[str, Column] = {}
    for i, (out, key) in enumerate(CORE_FIELDS):
        f, fk, ft = c(f"_f{i}"), c(f"_f{i}_k"), c(f"_f{i}_t")
        errs.append(F.when(ft & (fk != STRING), F.lit(f"{key} not a string")))
        val = F.when(ft & (fk == STRING), py_strip(F.try_variant_get(f, "$", "string"))).otherwise(F.lit(""))
        if out == "scopus_id":
            val = py_strip(F.replace(val, F.lit(ID_PREFIX), F.lit("")))
        cols[out] = val

    # keywords (P3/P4)
    errs += [
        F.when(kct & (c("_kc_k") != OBJECT), F.lit("authkeywords not an object")),
        F.when(kct & (rk_k == NULL), F.lit("author-keyword null")),
        F.when(kct & rk_k.isin(NUMBER, BOOLEAN), F.lit("author-keyword not a list")),
        F.when(F.exists(c("_kw2"), lambda x: x["obj"] & ~x["dk"].isin(MISSING, STRING)),
               F.lit("keyword value not a string")),
    ]
    from_list = F.transform(F.filter(c("_kw2"), lambda x: x["obj"]),
                            lambda x: F.coalesce(py_strip(F.try_variant_get(x["d"], "$", "string")), F.lit("")))
    from_str = F.array(py_strip(F.try_variant_get(rk, "$", "string")))
    kws = F.when(kct & (rk_k == STRING), from_str).otherwise(from_list)
    cols["mots_cles"] = F.filter(kws, lambda k: k != "")

    # research domain (P5)
    errs.append(F.when(sa_t & (sa_k == ARRAY) & (c("_sa_first_k") != OBJECT),
                       F.lit("first subject-area not an object")))
    errs.append(F.when(~c("_abbrev_k").isin(MISSING, NULL, STRING), F.lit("subject abbrev not a string")))
    cols["domaine_recherche"] = F.coalesce(
        F.when(c("_abbrev_k") == STRING, F.try_variant_get(c("_abbrev"), "$", "string")), F.lit(""))

    # authors (P6) and their affiliations
    errs.append(F.when(au_t & au_k.isin(NUMBER, BOOLEAN), F.lit("author not a list")))
    errs.append(_first_non_null(F.transform(c("_authors"), lambda x: x["err"])))
    cols["auteurs"] = F.transform(c("_authors"), lambda x: F.struct(
        x["scopus_author_id"].alias("scopus_author_id"), x["nom_complet"].alias("nom_complet"),
        x["orcid"].alias("orcid"), x["affiliations"].alias("affiliations")))

    # The trailing always-NULL branch is nondeterministic on purpose: it stops
    # Catalyst from pushing later filters through this projection, which would
    # re-inline every stage into the predicate (exponential plan growth).
    barrier = F.when(F.spark_partition_id() < 0, F.lit("unreachable"))
    reason = F.when(judged, F.coalesce(*errs, barrier)).otherwise(c("_p_reject_reason"))
    return df.select("seq", "value", *[F.when(c("_plain"), c(f"_p_{n}")).otherwise(cols[n]).alias(n)
                                       for n in CLEAN_COLUMNS if n != "seq"], reason.alias("reject_reason"))


def clean(raw: DataFrame) -> DataFrame:
    """Accepted records, P24 applied (id and normalised title both empty -> dropped)."""
    ok = validate(raw).where(F.col("reject_reason").isNull())
    return ok.where((F.col("scopus_id") != "") | (norm_title("titre") != "")).select(*CLEAN_COLUMNS)


def rejects(raw: DataFrame) -> DataFrame:
    """Rejected records: (seq, reason, value), kept apart and explained."""
    return (validate(raw).where(F.col("reject_reason").isNotNull())
            .select("seq", F.col("reject_reason").alias("reason"), "value"))
