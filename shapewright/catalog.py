"""Registered queries: operators of the schema language over the driver's tables, with the same in DuckDB's SQL.

Each returns a row's key and whether it conforms, over the whole table.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.columns import NotColumnar
from .operators.conformance import csv_file_rows, csv_rows, error_rows, lints, report, sampled, spread, struct_types, validate
from .operators.references import dangling
from .schema import Schema


@dataclass(frozen=True)
class Check:
    """A schema over one column of a table; ``column`` is a Spark expression, ``sql`` the predicate in DuckDB."""

    table: str
    keys: tuple[str, ...]
    column: str
    schema: str
    sql: str
    format: str = "row"
    tier: str = "auto"
    features: tuple[str, ...] | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.tier != "matcher":
            try:
                return self._checked(rows, "columns")
            except NotColumnar:
                if self.tier == "columns":
                    raise
        return self._checked(spread(rows), "matcher")

    def _checked(self, rows: DataFrame, tier: str) -> DataFrame:
        made = rows.select(*self.keys, F.expr(self.column).alias("_value"))
        features = None if self.features is None else list(self.features)
        return validate(made, self.schema, "_value", format=self.format, tier=tier, features=features).select(*self.keys, "valid")

    @property
    def oracle(self) -> str:
        return f"SELECT {', '.join(self.keys)}, coalesce({self.sql}, false) AS valid FROM {self.table}"


LINE, PART, ORDER, DOC, EVENT, VEC = (("l_orderkey", "l_linenumber"), ("p_partkey",), ("o_orderkey",), ("doc_id",), ("event_id",), ("vec_id",))
_MIXED_JSON = "CASE WHEN event_id % 3 = 0 THEN event_type ELSE props END"
_DATES = "CASE WHEN event_id % 4 = 0 THEN date_format(ts, 'yyyy-MM-dd') ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END"
_K = "json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(props, '$.k') AS BIGINT)"

CHECKS: dict[str, Check] = {
    "range_inclusive": Check("lineitem", LINE, "l_linenumber", "n = 2..5", "l_linenumber BETWEEN 2 AND 5"),
    "range_exclusive": Check("lineitem", LINE, "l_linenumber", "n = 2...5", "l_linenumber >= 2 AND l_linenumber < 5"),
    "range_float": Check("lineitem", LINE, "l_discount", "n = 0.02..0.05", "l_discount BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.05 AS DOUBLE)"),
    "range_named": Check("lineitem", LINE, "l_linenumber", "n = low .. high\nlow = 2\nhigh = 4", "l_linenumber BETWEEN 2 AND 4"),
    "range_mixed_sign": Check("customer", ("c_custkey",), "cast(c_acctbal as bigint)", "n = -100..5000", "CAST(round(c_acctbal - 0.5 * sign(c_acctbal) + 0.0) AS BIGINT) BETWEEN -100 AND 5000"),
    "ctl_lt": Check("part", PART, "p_size", "n = uint .lt 25", "p_size < 25"),
    "ctl_le": Check("part", PART, "p_size", "n = int .le 25", "p_size <= 25"),
    "ctl_gt": Check("part", PART, "p_retailprice", "n = float .gt 950.5", "p_retailprice > 950.5"),
    "ctl_ge": Check("part", PART, "p_size", "n = int .ge 30", "p_size >= 30"),
    "ctl_eq": Check("orders", ORDER, "o_orderstatus", 'n = tstr .eq "F"', "o_orderstatus = 'F'"),
    "ctl_ne_text": Check("orders", ORDER, "o_orderstatus", 'n = tstr .ne "F"', "o_orderstatus <> 'F'"),
    "choice_literal": Check("lineitem", LINE, "l_returnflag", 'n = "A" / "R"', "l_returnflag IN ('A', 'R')"),
    "choice_augmented": Check("lineitem", LINE, "l_returnflag", 'n = f\nf = "A"\nf /= "N"', "l_returnflag IN ('A', 'N')"),
    "socket": Check("lineitem", LINE, "l_returnflag", 'n = $flag\n$flag /= "A"\n$flag /= "R"', "l_returnflag IN ('A', 'R')"),
    "enum_group": Check("orders", ORDER, "o_orderpriority", 'n = &( u: "1-URGENT", h: "2-HIGH" )', "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "size_text_range": Check("documents", DOC, "text", "n = tstr .size (1..500)", "strlen(text) BETWEEN 1 AND 500"),
    "size_uint": Check("orders", ORDER, "o_custkey", "n = uint .size 1", "o_custkey < 256"),
    "size_bytes": Check("documents", DOC, "cast(lang || source as binary)", "n = bstr .size 6", "strlen(lang || source) = 6"),
    "bits": Check("orders", ORDER, "o_custkey", "n = uint .bits 3", "(o_custkey >> 3) & 1 = 1"),
    "bitfield": Check("orders", ORDER, "o_custkey", "n = uint .bitfield [4, 3, 1]", "o_custkey < 256"),
    "regexp_unanchored": Check("part", PART, "p_type", 'n = tstr .regexp "[EO]M"', "regexp_matches(p_type, '[EO]M')"),
    "pcre_anchored": Check("customer", ("c_custkey",), "c_name", 'n = tstr .pcre "Customer#[0-9]*[02468]"', "regexp_full_match(c_name, 'Customer#[0-9]*[02468]')"),
    "iregexp": Check("part", PART, "p_brand", 'n = tstr .iregexp "Brand#[1-3][0-9]*"', "regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')"),
    "ctl_and": Check("part", PART, "p_size", "n = (uint .gt 5) .and (uint .le 30)", "p_size > 5 AND p_size <= 30"),
    "ctl_within": Check("part", PART, "p_size", "n = (10..20) .within uint", "p_size BETWEEN 10 AND 20"),
    "ctl_default": Check("part", PART, "p_size", "n = (1..20) .default 5", "p_size BETWEEN 1 AND 20"),
    "ctl_hex": Check("region", ("r_regionkey",), "hex(r_name)", "n = tstr .hex 'ASIA'", "lower(hex(r_name)) = '41534941'"),
    "ctl_hexuc": Check("region", ("r_regionkey",), "CASE WHEN r_regionkey % 2 = 0 THEN hex(r_name) ELSE lower(hex(r_name)) END", "n = tstr .hexuc ('ASIA' / 'AFRICA' / 'EUROPE')", "r_regionkey % 2 = 0 AND r_name IN ('ASIA', 'AFRICA', 'EUROPE')"),
    "ctl_b64c": Check("region", ("r_regionkey",), "base64(cast(r_name as binary))", "n = tstr .b64c 'ASIA'", "to_base64(encode(r_name)) = 'QVNJQQ=='"),
    "ctl_b64u": Check("region", ("r_regionkey",), "rtrim('=', base64(cast(r_name as binary)))", "n = tstr .b64u 'ASIA'", "rtrim(to_base64(encode(r_name)), '=') = 'QVNJQQ'"),
    "ctl_base10": Check("nation", ("n_nationkey",), "cast(n_nationkey as string)", "n = tstr .base10 7", "CAST(n_nationkey AS VARCHAR) = '7'"),
    "ctl_printf": Check("supplier", ("s_suppkey",), "printf('%05d', s_suppkey)", 'n = tstr .printf ["%05d", 3]', "printf('%05d', s_suppkey) = '00003'"),
    "ctl_join": Check("customer", ("c_custkey",), "c_name", 'n = tstr .join ["Customer#0000001", tstr]', "starts_with(c_name, 'Customer#0000001')"),
    "ctl_cat": Check("lineitem", LINE, "l_returnflag || l_linestatus", 'n = ("A" / "N") .cat "F"', "l_returnflag || l_linestatus IN ('AF', 'NF')"),
    "ctl_plus": Check("lineitem", LINE, "l_linenumber", "n = 1 .plus 2", "l_linenumber = 3"),
    "ctl_json": Check("events", EVENT, _MIXED_JSON, "n = tstr .json { k: int }", "event_id % 3 <> 0 AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND len(json_keys(props)) = 1"),
    "ctl_feature": Check("part", PART, "p_size", 'n = ((1..10) .feature "low") / ((41..50) .feature "high")', "p_size BETWEEN 1 AND 10", features=("low",)),
    "ctl_abnf": Check("part", PART, "p_brand", 'n = tstr .abnf "brand\\nbrand = %s\\"Brand#\\" 1*%x31-33"', "regexp_full_match(p_brand, 'Brand#[1-3]+')"),
    "generic": Check("part", PART, "p_size", "n = opt<uint .lt 10>\nopt<T> = T / 49", "p_size < 10 OR p_size = 49"),
    "map_closed": Check("events", EVENT, "props", "event = { k: 0..49 }", f"{_K} BETWEEN 0 AND 49 AND len(json_keys(props)) = 1", "json"),
    "map_closed_matcher": Check("events", EVENT, "props", "event = { k: 0..49 }", f"{_K} BETWEEN 0 AND 49 AND len(json_keys(props)) = 1", "json", "matcher"),
    "map_optional": Check("events", EVENT, "CASE WHEN event_id % 5 = 0 THEN '{}' ELSE props END", "event = { ? k: 0..49 }", f"event_id % 5 = 0 OR {_K} BETWEEN 0 AND 49", "json"),
    "map_table": Check("events", EVENT, "props", "event = { * tstr => 10..60 }", f"{_K} BETWEEN 10 AND 60", "json"),
    "map_cut": Check("events", EVENT, "props", "event = { ? k: 0..49, * tstr => int }", f"{_K} BETWEEN 0 AND 49", "json"),
    "map_unwrap": Check("events", EVENT, "props", "event = { ~base }\nbase = { k: 20..80 }", f"{_K} BETWEEN 20 AND 80", "json"),
    "struct_row": Check("orders", ORDER, "named_struct('s', o_orderstatus, 'p', o_totalprice)", 'row = { s: "O" / "F", p: float .lt 150000.0 }', "o_orderstatus IN ('O', 'F') AND o_totalprice < 150000.0"),
    "group_choice": Check("events", EVENT, "named_struct('t', event_type, 'v', value)", 'row = { t: "purchase", v: float .gt 50.0 // t: "click" / "view", v: float }', "(event_type = 'purchase' AND value > 50) OR event_type IN ('click', 'view')"),
    "array_homogeneous": Check("embeddings", VEC, "slice(embedding, 1, 60 + int(vec_id % 5))", "n = [61*63 float]", "vec_id % 5 BETWEEN 1 AND 3"),
    "array_forall": Check("embeddings", VEC, "embedding", "n = [* -0.3..0.3]", "len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) BETWEEN CAST(-0.3 AS DOUBLE) AND CAST(0.3 AS DOUBLE))) = len(embedding)"),
    "array_prefix": Check("embeddings", VEC, "embedding", "n = [float .gt 0.0, float, * float .gt -0.35]", "embedding[1] > 0 AND len(list_filter(embedding[3:], lambda x: CAST(x AS DOUBLE) > CAST(-0.35 AS DOUBLE))) = len(embedding) - 2"),
    "array_json": Check("events", EVENT, "concat('[', event_id % 7, ',\"', event_type, '\"]')", 'n = [0..4, "click" / "view"]', "event_id % 7 <= 4 AND event_type IN ('click', 'view')", "json"),
    "array_sequence": Check("events", EVENT, "concat('[', event_id % 3, ',\"', event_type, '\",', event_id % 5, ']')", "n = [+ (int, tstr), 0..2]", "event_id % 5 <= 2", "json"),
    "tdate": Check("events", EVENT, _DATES, "n = tdate", "event_id % 4 <> 0"),
    "uri": Check("pages", ("page_id",), "CASE WHEN page_id % 3 = 0 THEN concat('no ', url) ELSE url END", "n = uri", "page_id % 3 <> 0"),
    "number_lexemes": Check("events", EVENT, "concat('{\"n\":', event_id % 3, CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '' END, '}')", "n = { n: uint }", "event_id % 2 = 1", "json"),
    "csv_uint": Check("nation", ("n_nationkey",), "CASE WHEN n_nationkey % 2 = 0 THEN cast(n_nationkey as string) ELSE n_name END", "n = [[uint]]", "n_nationkey % 2 = 0", "csv"),
}


_REGION = ("r_regionkey",)
_TIMES = "concat('[', concat_ws(',', array_repeat('1', int(event_id % 5))), ']')"


def _region(text: str, other: str = "r_name") -> str:
    """ASIA's row has this text."""
    return f"CASE WHEN r_name = 'ASIA' THEN '{text}' ELSE {other} END"


def _hex(*parts: str) -> str:
    return f"unhex(concat({', '.join(parts)}))"


_KEY4 = "'1A', lpad(hex(p_partkey), 8, '0')"

#: The same for forms of documents that are put together in SQL.
CHECKS |= {
    # kinds and literals
    "kind_bool": Check("events", EVENT, "CASE WHEN event_id % 3 = 0 THEN 'true' ELSE '1' END", "n = bool", "event_id % 3 = 0", "json"),
    "kind_null": Check("events", EVENT, "CASE WHEN event_id % 3 = 0 THEN 'null' ELSE 'false' END", "n = nil", "event_id % 3 = 0", "json"),
    "kind_nint": Check("events", EVENT, "cast(event_id % 5 - 2 as string)", "n = nint", "event_id % 5 < 2", "json"),
    "kind_number": Check("events", EVENT, "CASE event_id % 3 WHEN 0 THEN '1.5' WHEN 1 THEN '7' ELSE '\"7\"' END", "n = number", "event_id % 3 < 2", "json"),
    "kind_any": Check("events", EVENT, "CASE WHEN event_id % 2 = 0 THEN props ELSE '{' END", "n = any", "event_id % 2 = 0", "json"),
    "kind_b64url": Check("region", _REGION, _region("QVNJQQ", "'a+b'"), "n = b64url", "r_name = 'ASIA'"),
    "kind_time": Check("events", EVENT, "CASE WHEN event_id % 2 = 0 THEN cast(event_id as string) ELSE '\"x\"' END", "n = time", "event_id % 2 = 0", "json"),
    "literal_number": Check("lineitem", LINE, "l_discount", "n = 0.05 / 7", "abs(l_discount - CAST(0.05 AS DOUBLE)) < 2e-16"),
    "literal_bytes": Check("region", _REGION, "cast(r_name as binary)", "n = h'41534941' / 'EUROPE'", "r_name IN ('ASIA', 'EUROPE')"),
    "literal_radix": Check("lineitem", LINE, "l_linenumber", "n = 0x2 / 0b11", "l_linenumber IN (2, 3)"),
    "decode_errors": Check("events", EVENT, "CASE WHEN event_id % 3 = 0 THEN substring(props, 2) ELSE props END", "n = { * tstr => any }", "event_id % 3 <> 0", "json"),
    # occurrences
    "occur_optional": Check("events", EVENT, _TIMES, "n = [? int]", "event_id % 5 <= 1", "json"),
    "occur_plus": Check("events", EVENT, _TIMES, "n = [+ int]", "event_id % 5 >= 1", "json"),
    "occur_at_least": Check("events", EVENT, _TIMES, "n = [2* int]", "event_id % 5 >= 2", "json"),
    "occur_between": Check("events", EVENT, _TIMES, "n = [2*3 int]", "event_id % 5 BETWEEN 2 AND 3", "json"),
    "occur_at_most": Check("events", EVENT, _TIMES, "n = [*3 int]", "event_id % 5 <= 3", "json"),
    "occur_greedy": Check("events", EVENT, "concat('[1,1', CASE WHEN event_id % 2 = 0 THEN ',\"x\"' ELSE '' END, ']')", "n = [* int, (tstr // int)]", "event_id % 2 = 0", "json"),
    "array_group_choice": Check("events", EVENT, "concat('[', event_id % 3, CASE WHEN event_id % 2 = 0 THEN ',\"x\"' ELSE '' END, ']')", "n = [(0..1, tstr // int)]", "(event_id % 3 <= 1 AND event_id % 2 = 0) OR event_id % 2 = 1", "json"),
    "array_unwrap": Check("events", EVENT, "concat('[', event_id % 3, ',', event_id % 5, ']')", "n = [~pair]\npair = [0..1, 0..2]", "event_id % 3 <= 1 AND event_id % 5 <= 2", "json"),
    # maps
    "map_empty": Check("events", EVENT, "CASE WHEN event_id % 2 = 0 THEN '{}' ELSE props END", "n = {}", "event_id % 2 = 0", "json"),
    "map_group": Check("events", EVENT, "props", "n = { g }\ng = (k: 0..29)", f"{_K} BETWEEN 0 AND 29", "json"),
    "map_group_augmented": Check("events", EVENT, "CASE WHEN event_id % 2 = 0 THEN '{\"z\":true}' ELSE props END", "n = { g }\ng = (k: 0..29)\ng //= (z: bool)", f"event_id % 2 = 0 OR {_K} BETWEEN 0 AND 29", "json"),
    "map_socket": Check("events", EVENT, "CASE event_id % 3 WHEN 0 THEN replace(props, '{', '{\"z\":true,') WHEN 1 THEN replace(props, '{', '{\"z\":1,') ELSE props END", "n = { k: int, * $$more }\n$$more //= (z: bool)", "event_id % 3 <> 1", "json"),
    "map_order_of_alternates": Check("events", EVENT, "concat('{\"a\":', event_id % 4, '}')", "n = { g }\ng = (a: 0..1)\ng //= (a: 1..2)", "event_id % 4 <= 2", "json"),
    "map_flat_groups": Check("events", EVENT, "concat('{\"a\":1,\"b\":2,\"c\":', event_id % 4, '}')", "n = { * g }\ng = (tstr => 0..2)", "event_id % 4 <= 2", "json"),
    # whole documents
    "json_trailing": Check("events", EVENT, "CASE event_id % 4 WHEN 0 THEN concat(props, 'x') WHEN 1 THEN concat(props, ' ') WHEN 2 THEN concat(props, ',', props) ELSE props END", "n = { * tstr => any }", "event_id % 4 IN (1, 3)", "json"),
    "json_repeated_keys": Check("events", EVENT, "concat('{\"k\":\"x\",\"k\":', event_id % 5, '}')", "n = { k: 0..2 }", "event_id % 5 <= 2", "json"),
    "json_repeated_keys_matcher": Check("events", EVENT, "concat('{\"k\":\"x\",\"k\":', event_id % 5, '}')", "n = { k: 0..2 }", "event_id % 5 <= 2", "json", "matcher"),
    "regexp_dot": Check("events", EVENT, "concat('a', CASE event_id % 4 WHEN 0 THEN char(10) WHEN 1 THEN char(13) WHEN 2 THEN decode(unhex('E280A8'), 'UTF-8') ELSE 'x' END, 'b')", 'n = tstr .regexp "^a.b$"', "event_id % 4 <> 0"),
    "regexp_end": Check("events", EVENT, "concat('ab', CASE WHEN event_id % 2 = 0 THEN char(10) ELSE '' END)", 'n = tstr .regexp "^ab$"', "event_id % 2 = 1"),
    "map_table_first": Check("events", EVENT, "props", "n = { * tstr => 0..9, k: int }", f"NOT ({_K} BETWEEN 0 AND 9)", "json"),
    "map_single_typed_keys": Check("events", EVENT, "concat('{\"a\":', event_id % 2, ',\"b\":\"x\"}')", "n = { tstr => tstr, tstr => 1 }", "event_id % 2 = 1", "json"),
    "map_count": Check("events", EVENT, "CASE event_id % 3 WHEN 0 THEN '{}' WHEN 1 THEN props ELSE replace(props, '}', ',\"y\":1,\"z\":2}') END", "n = { 1*2 tstr => int }", "event_id % 3 = 1", "json"),
    # controls
    "ctl_hexlc": Check("region", _REGION, "CASE WHEN r_regionkey % 2 = 0 THEN lower(hex(r_name)) ELSE hex(r_name) END", "n = tstr .hexlc ('ASIA' / 'AFRICA' / 'EUROPE')", "r_regionkey % 2 = 0 AND r_name IN ('ASIA', 'AFRICA', 'EUROPE')"),
    "ctl_b32": Check("region", _REGION, _region("IFJUSQI"), "n = tstr .b32 'ASIA'", "r_name = 'ASIA'"),
    "ctl_h32": Check("region", _REGION, _region("859KIG8"), "n = tstr .h32 'ASIA'", "r_name = 'ASIA'"),
    "ctl_b45": Check("region", _REGION, _region("SB8XB9"), "n = tstr .b45 'ASIA'", "r_name = 'ASIA'"),
    "ctl_b64u_sloppy": Check("region", _REGION, "base64(cast(r_name as binary))", "n = tstr .b64u-sloppy 'ASIA'", "r_name = 'ASIA'"),
    "ctl_b64c_sloppy": Check("region", _REGION, "rtrim('=', base64(cast(r_name as binary)))", "n = tstr .b64c-sloppy 'ASIA'", "r_name = 'ASIA'"),
    "ctl_det": Check("region", _REGION, "r_name || '.'", 'n = "  ASIA" .det " ."', "r_name = 'ASIA'"),
    "ctl_json_deep": Check("events", EVENT, "props", "n = tstr .json { k: 10..19 }", f"{_K} BETWEEN 10 AND 19"),
    # CBOR
    "cbor_uint": Check("part", PART, _hex(_KEY4), "n = uint .size 1", "p_partkey < 256", "cbor"),
    "cbor_negative": Check("part", PART, _hex("hex(32 + p_size % 10)"), "n = #1.4", "p_size % 10 = 4", "cbor"),
    "cbor_float": Check("part", PART, "CASE WHEN p_partkey % 2 = 0 THEN unhex('F93E00') ELSE unhex('02') END", "n = 1.0..2.0", "p_partkey % 2 = 0", "cbor"),
    "cbor_text_major": Check("part", PART, _hex("hex(96 + length(p_brand))", "hex(p_brand)"), "n = #3.8", "length(p_brand) = 8", "cbor"),
    "cbor_simple": Check("part", PART, "CASE p_partkey % 3 WHEN 0 THEN unhex('F6') WHEN 1 THEN unhex('F7') ELSE unhex('F4') END", "n = undefined / false", "p_partkey % 3 > 0", "cbor"),
    "cbor_tag": Check("part", PART, _hex("CASE WHEN p_partkey % 2 = 0 THEN 'D820' ELSE 'D821' END", "hex(96 + length(p_brand))", "hex(p_brand)"), "n = #6.32(tstr)", "p_partkey % 2 = 0", "cbor"),
    "cbor_tag_type": Check("part", PART, _hex("hex(192 + p_size % 10)", "'01'"), "n = #6.<2..4>(uint)", "p_size % 10 BETWEEN 2 AND 4", "cbor"),
    "cbor_bignum": Check("part", PART, _hex("CASE WHEN p_partkey % 2 = 0 THEN 'C2' ELSE 'C3' END", "'44', lpad(hex(p_partkey), 8, '0')"), "n = biguint", "p_partkey % 2 = 0", "cbor"),
    "cbor_unwrap": Check("part", PART, _hex("CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'C6' END", "'6161'"), "n = ~t\nt = #6.99(tstr)", "p_partkey % 2 = 0", "cbor"),
    "cbor_embedded": Check("part", PART, _hex("'45'", _KEY4), "n = bstr .cbor (uint .lt 1000)", "p_partkey < 1000", "cbor"),
    "cbor_sequence": Check("part", PART, _hex("'46'", _KEY4, "lpad(hex(p_size % 10), 2, '0')"), "n = bstr .cborseq [uint, 0..4]", "p_size % 10 <= 4", "cbor"),
    "cbor_bits": Check("part", PART, _hex("'42', lpad(hex(p_partkey % 256), 2, '0'), lpad(hex(p_size % 8), 2, '0')"), "n = bstr .bits 9", "(p_size % 8) & 2 = 2", "cbor"),
    "cbor_abnfb": Check("part", PART, _hex("hex(64 + length(p_brand))", "hex(p_brand)"), 'n = bstr .abnfb "b\\nb = %s\\"Brand#\\" 1*%x31-33"', "regexp_full_match(p_brand, 'Brand#[1-3]+')", "cbor"),
    "cbor_range_of_bytes": Check("part", PART, _hex("hex(64 + length(p_brand))", "hex(p_brand)"), "n = bstr .size (8..9)", "length(p_brand) = 8", "cbor"),
    "cbor_repeated_keys": Check("part", PART, _hex("'A201', lpad(hex(p_size % 10), 2, '0'), CASE WHEN p_partkey % 2 = 0 THEN '01' ELSE '02' END, '05'"), "n = { 1: uint, ? 2: uint }", "p_partkey % 2 = 1", "cbor"),
    "cbor_key_domains": Check("part", PART, _hex("'A20161610261', CASE WHEN p_partkey % 2 = 0 THEN '62' ELSE 'FF' END"), "n = { * int => tstr }", "p_partkey % 2 = 0", "cbor"),
    "cbor_composite_keys": Check("part", PART, _hex("'A182', lpad(hex(p_size % 10), 2, '0'), '02F5'"), "n = { [0..4, 2] => true }", "p_size % 10 <= 4", "cbor"),
    "cbor_reassigned_pairs": Check("part", PART, _hex("'A2014178', CASE WHEN p_partkey % 2 = 0 THEN '026179' ELSE '024179' END"), "n = { int => tstr, int => bstr }", "p_partkey % 2 = 0", "cbor"),
    "cbor_cut": Check("part", PART, _hex("'A1616B', lpad(hex(p_size % 10), 2, '0')"), 'n = { ? "k" ^ => 0..4, * tstr => uint }', "p_size % 10 <= 4", "cbor"),
    "cbor_no_cut": Check("part", PART, _hex("'A1616B', lpad(hex(p_size % 10), 2, '0')"), 'n = { ? "k" => 0..4, * tstr => 7..9 }', "p_size % 10 <= 4 OR p_size % 10 >= 7", "cbor"),
    "cbor_group_choice": Check("part", PART, _hex("'A2616101', CASE WHEN p_partkey % 2 = 0 THEN '6162' ELSE '6163' END, lpad(hex(p_size % 10), 2, '0')"), "n = { a: 1, b: 0..4 // a: 1, c: 5..9 }", "(p_partkey % 2 = 0 AND p_size % 10 <= 4) OR (p_partkey % 2 = 1 AND p_size % 10 >= 5)", "cbor"),
    "cbor_float_widths": Check("part", PART, "unhex(CASE p_partkey % 3 WHEN 0 THEN 'F93E00' WHEN 1 THEN 'FA3FC00000' ELSE 'FB3FF8000000000000' END)", "n = float16 / float64", "true", "cbor"),
    "cbor_nan_keys": Check("part", PART, "unhex(CASE WHEN p_partkey % 2 = 0 THEN 'A1F97E0001' ELSE 'A1616101' END)", "n = { * float => int }", "p_partkey % 2 = 0", "cbor"),
    "cbor_bytes_in_ranges": Check("part", PART, "unhex(CASE WHEN p_partkey % 2 = 0 THEN '4103' ELSE '46010203040506' END)", "n = 1..5", "p_partkey % 2 = 0", "cbor"),
    "cbor_trailing": Check("part", PART, _hex("'01', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '02' END"), "n = 1", "p_partkey % 2 = 0", "cbor"),
}


_BACK = "concat('\"', char(92), "
#: The same for documents that are odd: long numbers, halves of characters, depth, NaN, empty maps; and for expressions' classes.
CHECKS |= {
    "json_long_numbers": Check("events", EVENT, "concat('{\"k\":', CASE WHEN event_id % 3 = 0 THEN repeat('9', 400) ELSE cast(event_id % 7 as string) END, '}')", "n = { k: number }", "event_id % 3 <> 0", "json"),
    "json_long_numbers_matcher": Check("events", EVENT, "concat('{\"k\":', CASE WHEN event_id % 3 = 0 THEN repeat('9', 400) ELSE cast(event_id % 7 as string) END, '}')", "n = { k: number }", "event_id % 3 <> 0", "json", "matcher"),
    "json_surrogates": Check("events", EVENT, f"CASE event_id % 3 WHEN 0 THEN {_BACK}'ud800\"') WHEN 1 THEN {_BACK}'ud83d', char(92), 'ude00\"') ELSE '\"abcde\"' END", "n = tstr .size (1..4)", "event_id % 3 = 1", "json"),
    "json_surrogates_matcher": Check("events", EVENT, f"CASE event_id % 3 WHEN 0 THEN {_BACK}'ud800\"') WHEN 1 THEN {_BACK}'ud83d', char(92), 'ude00\"') ELSE '\"abcde\"' END", "n = tstr .size (1..4)", "event_id % 3 = 1", "json", "matcher"),
    "recursive_deep": Check("part", PART, "concat(repeat('[', 300 + int(p_partkey % 2) * 800), repeat(']', 300 + int(p_partkey % 2) * 800))", "n = [* n]", "p_partkey % 2 = 0", "json"),
    "csv_long_fields": Check("part", PART, "CASE WHEN p_partkey % 2 = 0 THEN repeat('9', 5000) ELSE '7' END", "n = [[uint]]", "p_partkey % 2 = 1", "csv"),
    "row_nan": Check("part", PART, "CASE WHEN p_partkey % 3 = 0 THEN double('NaN') ELSE p_retailprice END", "n = float .gt 950.5", "p_partkey % 3 <> 0 AND p_retailprice > 950.5"),
    "row_nan_matcher": Check("part", PART, "CASE WHEN p_partkey % 3 = 0 THEN double('NaN') ELSE p_retailprice END", "n = float .gt 950.5", "p_partkey % 3 <> 0 AND p_retailprice > 950.5", tier="matcher"),
    "row_empty_map": Check("part", PART, "map_filter(map('size', p_size), (k, v) -> v > 25)", "n = {}", "p_size <= 25"),
    "row_empty_map_matcher": Check("part", PART, "map_filter(map('size', p_size), (k, v) -> v > 25)", "n = {}", "p_size <= 25", tier="matcher"),
    "regexp_nested_classes": Check("part", PART, "p_brand", 'n = tstr .regexp "^[[:alpha:]]+#[1-5&&[^2-4]]"', "regexp_matches(p_brand, '^[A-Za-z]+#[15]')"),
    "regexp_nested_classes_matcher": Check("part", PART, "p_brand", 'n = tstr .regexp "^[[:alpha:]]+#[1-5&&[^2-4]]"', "regexp_matches(p_brand, '^[A-Za-z]+#[15]')", tier="matcher"),
    "pcre_references": Check("part", PART, "p_brand", 'n = tstr .pcre "Brand#(?<x>[0-9])\\\\k<x>"', "p_brand[7] = p_brand[8] AND length(p_brand) = 8"),
    "array_choices_of_groups": Check("events", EVENT, "concat('[', concat_ws(',', transform(sequence(1, 1 + int(event_id % 3)), i -> concat(event_id % 4, ',\"', event_type, '\"'))), ',true]')", 'n = [+ (0..2, "click" // 0..1, tstr), bool]', "event_id % 4 <= 1 OR (event_id % 4 = 2 AND event_type = 'click')", "json"),
}


#: Tagged names of the prelude: tag, a body that fits, and one that doesn't.
_TAGS = {
    "decfrac": ("C4", "820001", "8100"),
    "bigfloat": ("C5", "820001", "8100"),
    "eb64url": ("D5", "4101", None),
    "eb64legacy": ("D6", "4101", None),
    "eb16": ("D7", "4101", None),
    "encoded-cbor": ("D818", "4101", "6161"),
    "regexp": ("D823", "6161", "4101"),
    "mime-message": ("D824", "6161", "4101"),
    "cbor-any": ("D9D9F7", "01", None),
}
CHECKS |= {
    f"cbor_{name.replace('-', '_')}": Check("part", PART, f"unhex(CASE p_partkey % 3 WHEN 0 THEN '{tag}{good}' WHEN 1 THEN 'D9FFFF{good}' ELSE '{tag}{bad or good}' END)", f"n = {name}", "p_partkey % 3 = 0" if bad else "p_partkey % 3 <> 1", "cbor")
    for name, (tag, good, bad) in _TAGS.items()
}


def _error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("props")
    return report(rows, "event = { k: int .lt 50 }", "props").select("rule", "reason", "n")


def _csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/orders.parquet")).select("o_orderkey", F.format_string('status,price\n%s,%s\n"%s","x, y"\n', "o_orderstatus", F.col("o_custkey").cast("string"), "o_orderpriority").alias("csv"))
    return csv_rows(rows, 'file = [["status", "price"], * ["O" / "F", uint]]', "csv", has_header=True).select("o_orderkey", "row", "valid")


def _recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", F.concat(F.lit('{"v":1,"c":[{"v":'), F.when(F.col("event_id") % 4 == 0, F.lit('"x"')).otherwise(F.col("event_id").cast("string")), F.lit("}]}")).alias("doc"))
    return validate(rows, "tree = { v: int, ? c: [* tree] }", "doc").select("event_id", "valid")


def _cbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CBOR maps put together in SQL: {1: key, 2: text of 1 to 23 bytes}."""
    name = F.substring("p_brand", 1, 20)
    head = F.concat(F.lit("A2011A"), F.lpad(F.hex(F.col("p_partkey")), 8, "0"), F.lit("02"), F.hex(F.lit(96) + F.octet_length(name)), F.hex(name))
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select("p_partkey", F.unhex(head).alias("doc"))
    return validate(rows, 'part = { 1: uint .size 1, 2: tstr .regexp "[1-3]" }', "doc", format="cbor").select("p_partkey", "valid")


def _error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return error_rows(rows, "event = { k: 0..49 }", "props").select("event_id", "location", "rule", "reason", "message")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of a schema for each order, drawn by its key, checked."""
    schema = Schema.parse('order = { id: uint, status: "O" / "F", lines: [1*3 line], ? note: tstr }\nline = { n: 1..7, price: float }')
    rows = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return validate(sampled(rows, schema, "o_orderkey", "doc"), schema, "doc").select("o_orderkey", "valid")


def _lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lints of schemas, one for each part."""
    text = F.concat(F.lit("a = { x: "), F.when(F.col("p_partkey") % 2 == 0, F.lit("int")).otherwise(F.lit("tstr")), F.lit(' .regexp "y" }\nu'), (F.col("p_size") % 10).cast("string"), F.lit(" = tstr\nloop = [* loop]"))
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select("p_partkey", text.alias("text"))
    return lints(rows, "text").drop("text")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row types of schemas, one for each part."""
    text = F.concat(F.lit("person = { name: tstr, ? age: uint, mail: [* "), F.when(F.col("p_partkey") % 2 == 0, F.lit("tstr")).otherwise(F.lit("float")), F.lit("], more: { * tstr => int }, next: person / nil }"))
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select("p_partkey", text.alias("text"))
    return struct_types(rows, "text").drop("text")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in a folder that driver and executors share."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        local = spark.sparkContext.master.startswith("local")
        there = f"file://{tempfile.mkdtemp(prefix='scratch-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV files, with line ends and quotes in fields, read back in splits."""
    path = _scratch(spark, "orders-csv")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows.select(F.format_string('%d,"%s\n""%s""",%s', "o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"))).write.text(path)
    read = csv_file_rows(spark, path, 'file = [* [uint, tstr .regexp "\\n.F", uint .lt 500]]')
    return read.select(F.col("fields")[0].cast("bigint").alias("o_orderkey"), F.col("fields")[1].alias("text"), "valid")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name customers and orders, some of which there aren't."""
    doc = F.format_string('{"by":%d,"orders":[%d,{"id":%d}],"at":null}', F.col("user_id") * 20, F.col("event_id") % 5000 + 1, F.col("event_id") * 7)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", doc.alias("doc"))
    tables = {"customer": (spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey"), "orders": (spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")}
    schema = "doc = { by: ref-customer, orders: [* ref-orders / { id: ref-orders }], ? at: ref-customer / nil }\nref-customer = uint\nref-orders = uint"
    return dangling(rows, schema, "doc", tables).select("event_id", "location", F.col("table").alias("target"), "value")


_REFERENCES_ORACLE = """
WITH r AS (
  SELECT event_id, '/by' AS location, 'customer' AS target, user_id * 20 AS v FROM events UNION ALL
  SELECT event_id, '/orders/0', 'orders', event_id % 5000 + 1 FROM events UNION ALL
  SELECT event_id, '/orders/1/id', 'orders', event_id * 7 FROM events
)
SELECT event_id, location, target, CAST(v AS VARCHAR) AS value FROM r
WHERE (target = 'customer' AND v NOT IN (SELECT c_custkey FROM customer)) OR (target = 'orders' AND v NOT IN (SELECT o_orderkey FROM orders))
"""
_CSV_ORACLE = """
SELECT o_orderkey, 0::BIGINT AS row, true AS valid FROM orders UNION ALL
SELECT o_orderkey, 1::BIGINT AS row, o_orderstatus IN ('O', 'F') AS valid FROM orders UNION ALL
SELECT o_orderkey, 2::BIGINT AS row, false AS valid FROM orders
"""

_KEY = "CAST(json_extract(props, '$.k') AS BIGINT)"
_OUTSIDE = f"'expected 0 .. 49, got ' || {_KEY}"
_LINT_ORACLE = """
SELECT p_partkey, 'unused' AS kind, 'u' || (p_size % 10) AS rule, 'no rule refers to u' || (p_size % 10) AS message FROM part UNION ALL
SELECT p_partkey, 'unused', 'loop', 'no rule refers to loop' FROM part UNION ALL
SELECT p_partkey, 'recursive', 'loop', 'loop refers to itself' FROM part UNION ALL
SELECT p_partkey, 'control', 'a', '.regexp doesn''t fit int' FROM part WHERE p_partkey % 2 = 0
"""
_TYPES_ORACLE = """
SELECT p_partkey, 'person' AS rule,
'struct<name:string,age:decimal(20,0),mail:array<' || CASE WHEN p_partkey % 2 = 0 THEN 'string' ELSE 'double' END || '>,more:map<string,bigint>,next:variant>' AS type FROM part
"""

OTHERS = {
    "error_report": (_error_report, f"SELECT 'event' AS rule, 'expected int .lt 50, got ' || {_KEY} AS reason, count(*) AS n FROM events WHERE {_KEY} >= 50 GROUP BY {_KEY}"),
    "error_rows": (_error_rows, f"SELECT event_id, '/k' AS location, 'event' AS rule, {_OUTSIDE} AS reason, 'error validating at /k: ' || {_OUTSIDE} AS message FROM events WHERE NOT coalesce({_K} BETWEEN 0 AND 49, false)"),
    "csv_records": (_csv_records, _CSV_ORACLE),
    "csv_files": (_csv_files, "SELECT o_orderkey, o_orderpriority || chr(10) || '\"' || o_orderstatus || '\"' AS text, o_orderstatus = 'F' AND o_custkey < 500 AS valid FROM orders"),
    "references": (_references, _REFERENCES_ORACLE),
    "recursive_json": (_recursive, "SELECT event_id, event_id % 4 <> 0 AS valid FROM events"),
    "cbor_map": (_cbor, "SELECT p_partkey, p_partkey < 256 AND regexp_matches(p_brand, '[1-3]') AS valid FROM part"),
    "samples": (_samples, "SELECT o_orderkey, true AS valid FROM orders"),
    "lint": (_lint, _LINT_ORACLE),
    "types": (_types, _TYPES_ORACLE),
}


def queries() -> dict:
    return {**CHECKS, **{n: f for n, (f, _) in OTHERS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{n: c.oracle for n, c in CHECKS.items()}, **{n: sql for n, (_, sql) in OTHERS.items() if sql}}
