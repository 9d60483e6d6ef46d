"""What models and authors hand in as JSON or YAML: replies are found in their surroundings, repaired and read.

Parsing has no expression in the JVM, so it runs over Arrow batches; everything comes out as typed columns.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of a reply, in order, that become sections, lists and entity lists.
SECTION_KEYS = ("abstract", "problem_statement", "core_contribution", "key_insight", "methodology", "experimental_design", "key_findings", "related_work", "application", "limitations")
LIST_KEYS = ("authors", "affiliations", "emails", "keywords", "urls")
ENTITY_KEYS = ("species", "genes", "techniques", "pathways")
_FENCE = re.compile(r"```(json)?(.*?)```", re.S)
_STRING = r'"(?:[^"\\]|\\.)*"'
_TOKEN = re.compile(rf"{_STRING}|[{{}}\[\]]", re.S)
_COMMA = re.compile(rf"({_STRING})|,(?=\s*[}}\]])", re.S)

METADATA = (
    "json string, title string, paper_type string, published_date string, doi string, venue string, corresponding_author array<string>, "
    + ", ".join(f"{k} array<string>" for k in (*LIST_KEYS, *ENTITY_KEYS))
    + ", sections array<struct<section_type:string,content:string,content_hash:string>>, figures array<struct<label:string,caption:string>>"
)
FRONT_MATTER = "title string, authors array<string>, keywords array<string>, doi string, published_date string, abstract string, json string, body string"


def _read(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _outermost(text: str) -> list[str]:
    """The bracketed spans that stand in no other, brackets in strings aside."""
    depth, start, out = 0, 0, []
    for m in _TOKEN.finditer(text):
        if m[0] in "{[":
            start, depth = (m.start() if depth == 0 else start), depth + 1
        elif m[0] in "}]" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : m.end()])
    return out


def find_json(text: str) -> str:
    """The JSON in a reply: as it stands, else a fenced block (one marked json first), else the longest bracketed span."""
    text = text.strip()
    if _read(text) is not None:
        return text
    blocks = sorted(((not m[1], m.start(), m[2].strip()) for m in _FENCE.finditer(text) if m[2].strip()))
    return blocks[0][2] if blocks else max(_outermost(text), key=len, default=text)


def parse_reply(text: str | None):
    """The value of a reply, without commas before closing brackets if that helps; None if it is no JSON."""
    found = find_json(text or "")
    value = _read(found)
    if value is not None:
        return value
    spans = _outermost(found)
    return _read(_COMMA.sub(lambda m: m[1] or "", max(spans, key=len))) if spans else None


def _text(value) -> str | None:
    value = value.strip() if isinstance(value, str) else ""
    return value if value and value != "null" else None


def _texts(value, fold: bool = False) -> list[str]:
    kept: dict[str, str] = {}
    for x in value if isinstance(value, list) else []:
        x = (x.strip() or None if isinstance(x, str) else None) if fold else _text(x)
        if x:
            kept.setdefault(x.lower() if fold else x, x)
    return list(kept.values())


def string_or_list(value) -> list[str]:
    """Texts of a list, or the parts of a text: at commas, else at semicolons."""
    if isinstance(value, str):
        value = value.split("," if "," in value else ";")
    return [x.strip() for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list) else []


def read_metadata(text: str | None) -> dict:
    """A reply about a paper as METADATA; missing and malformed fields are null or empty."""
    value = parse_reply(text)
    o = value if isinstance(value, dict) else {}
    year = o.get("year")
    date = o["published_date"].strip() if isinstance(o.get("published_date"), str) else ""
    if not date and isinstance(year, int) and not isinstance(year, bool) and 1900 <= year <= 2100:
        date = str(year)
    kind = o.get("paper_type")
    out = {"json": None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")), "paper_type": kind.strip() or None if isinstance(kind, str) else None, "published_date": date or None}
    out |= {k: _text(o.get(k)) for k in ("title", "doi", "venue")} | {"corresponding_author": string_or_list(o.get("corresponding_author"))}
    out |= {k: _texts(o.get(k)) for k in LIST_KEYS} | {k: _texts(o.get(k), fold=True) for k in ENTITY_KEYS}
    sections = [(k, o[k]) for k in SECTION_KEYS if isinstance(o.get(k), str) and o[k].strip()]
    out["sections"] = [{"section_type": k, "content": c.strip(), "content_hash": hashlib.sha256(c.encode()).hexdigest()} for k, c in sections]
    figures = [[f[k].strip() if isinstance(f.get(k), str) else "" for k in ("label", "caption")] for f in (o.get("figures") if isinstance(o.get("figures"), list) else []) if isinstance(f, dict)]
    out["figures"] = [{"label": a, "caption": b} for a, b in figures if a and b]
    return out


def reply_metadata(reply: Column) -> Column:
    """A struct of METADATA."""

    @F.pandas_udf(METADATA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_metadata(t) for t in texts], columns=[x.split()[0] for x in _names(METADATA)])

    return run(reply)


def _names(ddl: str) -> list[str]:
    return re.split(r",\s+", ddl)


def json_reply(reply: Column) -> Column:
    """The JSON of a reply as text, repaired where that is needed; null if it has none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values = [parse_reply(t) for t in texts]
        return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values], dtype=object)

    return run(reply)


#: What str.strip takes off.
_WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(block, body) of a Markdown text; without a block, null and the text."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    at = F.locate("\n---", text, 5)
    has = text.startswith("---\n") & (at > 0)
    return F.when(has, F.substring(text, F.lit(5), at - 5)), F.when(has, F.btrim(F.substring(text, at + 4, F.length(text)), F.lit(_WHITE))).otherwise(text)


def _yaml(block: str):
    try:
        import yaml
    except ImportError:  # without a YAML library only blocks that are JSON are read
        return _read(block)
    try:
        # plain scalars stay texts, as a date or a number is written
        return yaml.load(block, Loader=yaml.BaseLoader)
    except yaml.YAMLError:
        return None


def read_front_matter(block: str | None) -> dict:
    """The front matter of a block as FRONT_MATTER without the body: scalars, flow and block lists, nested values (in
    ``json``).  A block that cannot be read gives nothing."""
    value = _yaml(block) if isinstance(block, str) else None
    o = value if isinstance(value, dict) else {}
    words = o.get("keywords") or o.get("tags")
    one = lambda *keys: next((x for k in keys if (x := _text(o.get(k)))), None)
    return {
        "title": one("title"), "authors": string_or_list(o.get("authors") or o.get("author")), "keywords": string_or_list(words), "doi": one("doi"), "published_date": one("date", "published_date", "year"),
        "abstract": one("abstract", "description"), "json": json.dumps(o, ensure_ascii=False) if o else None,
    }


def front_matter(text: Column) -> Column:
    """A struct of FRONT_MATTER.  Blocks alone are sent to Python, as they are short; bodies are not."""
    fields = FRONT_MATTER.removesuffix(", body string")

    @F.pandas_udf(fields)
    def run(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_front_matter(t) for t in blocks], columns=[x.split()[0] for x in _names(fields)])

    block, body = split_front_matter(text)
    return run(block).withField("body", body)
