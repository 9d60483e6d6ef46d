"""Tables of the library: types, keys, children, and how raw rows become typed ones.

Optional text is null, never ''; arrays are never null; vectors are arrays of floats with their norm beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
_SA = T.ArrayType(_S)
BBOX = T.StructType([T.StructField(n, T.FloatType()) for n in ("x", "y", "width", "height")])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES = {
    "papers": _table(id=_S, title=_S, authors=_SA, affiliations=_SA, venue=_S, doi=_S, abstract_text=_S, keywords=_SA, urls=_SA, emails=_SA, extra=_S, file_path=_S, file_hash=_S, cover_path=_S, status=_S, error_message=_S, retry_count=_I, paper_type=_S, published_date=_S, corresponding_author=_SA, data_availability=_S, embedding_model=_S, source=_S, updated_at=_TS),
    "sections": _table(id=_L, paper_id=_S, section_type=_S, content=_S, content_hash=_S, input_hash=_S, created_at=_TS),
    "chunks": _table(id=_S, paper_id=_S, parent_id=_S, chunk_type=_S, content=_S, seq=_I, start_pos=_I, end_pos=_I, page_number=_I, metadata=_S, path=_S, level=_I, depth=_I, created_at=_TS),
    "figures": _table(id=_S, paper_id=_S, caption=_S, description=_S, image_path=_S, page_number=_I, bbox=BBOX, figure_label=_S, created_at=_TS),
    "prompts": _table(id=_S, name=_S, description=_S, system_prompt=_S, temperature=T.DoubleType(), is_default=_B, created_at=_TS, updated_at=_TS),
    "store_meta": _table(key=_S, value=_S),
    "paper_entities": _table(paper_id=_S, kind=_S, value=_S),
    "paper_ratings": _table(paper_id=_S, rating=_I, updated_at=_TS),
    "paper_comments": _table(id=_L, paper_id=_S, content=_S, created_at=_TS),
    "llm_call_metrics": _table(id=_L, created_at=_TS, kind=_S, model=_S, prompt_tokens=_I, completion_tokens=_I, latency_ms=_L, success=_B, error=_S),
    "vectors": _table(id=_S, paper_id=_S, content_type=_S, section_type=_S, chunk_text=_S, vector=T.ArrayType(T.FloatType())),
    "translations": _table(id=_S, paper_id=_S, content_type=_S, content_ref=_S, target_language=_S, source_hash=_S, translated_text=_S, model=_S, created_at=_TS, updated_at=_TS),
}
KEYS = {"papers": ("id",), "sections": ("paper_id", "section_type"), "chunks": ("id",), "figures": ("id",), "prompts": ("id",), "store_meta": ("key",), "paper_entities": ("paper_id", "kind", "value"), "paper_ratings": ("paper_id",), "paper_comments": ("id",), "llm_call_metrics": ("id",), "vectors": ("id",), "translations": ("paper_id", "content_type", "content_ref", "target_language")}
#: Tables whose rows go with their paper.
CHILDREN = ("sections", "chunks", "figures", "paper_entities", "paper_ratings", "paper_comments", "vectors", "translations")
# The members of each enumeration, and what an unknown one is read as.
ENUMS = {
    "status": ("processing", "indexed", "failed"),
    "section_type": ("abstract", "introduction", "background", "methods", "results", "discussion", "conclusion", "limitations", "future_work", "contributions", "metadata"),
    "chunk_type": ("chapter", "section", "paragraph", "figure", "table"),
    "search_method": ("hybrid", "semantic", "fulltext"),
    "entity_kind": ("species", "gene", "technique", "pathway"),
}


def normalised(df: DataFrame, table: str) -> DataFrame:
    """Raw rows as the table's type: missing columns null, '' null, arrays from JSON text or null to arrays."""
    have, out = dict(df.dtypes), []
    for f in TABLES[table].fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if isinstance(f.dataType, T.ArrayType):
            if have.get(f.name) == "string":
                c = F.from_json(c, f.dataType)  # null where it is no JSON
            c = F.coalesce(c.cast(f.dataType), F.array().cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c.cast("string"), F.lit(""))
        else:
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def unknown_values(df: DataFrame, column: str, enum: str) -> DataFrame:
    """Rows whose value is none of the enumeration's."""
    return df.where(~F.col(column).isin(*ENUMS[enum]))
