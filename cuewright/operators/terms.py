"""Terms of a dictionary in texts: an automaton of all terms reads each text once.

The automaton (Aho and Corasick's) finds all terms of any number in one pass over a text, and each row gets its own, so
results depend neither on the dictionary's size nor on the rows' keys. Dictionaries go to the tasks in blocks of a checked
size; the rows pass once for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..sources.scratch import stored

#: Characters of the terms of one block; an automaton takes about fifty bytes a character.
TERM_BLOCK = 2_000_000

_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, forms: list[str]) -> ahocorasick.Automaton:
    """Built once for each Python worker and block; of several blocks the last one is kept."""
    if name not in _BUILT:
        places: dict[str, list[int]] = {}
        for k, form in enumerate(forms):
            places.setdefault(form, []).append(k)
        found = ahocorasick.Automaton()
        for form, where in places.items():
            found.add_word(form, where)
        found.make_automaton()
        _BUILT.clear()
        _BUILT[name] = found
    return _BUILT[name]


def _blocks(terms: DataFrame, form: str, block_chars: int) -> int:
    size = terms.agg(F.sum(F.length(form))).first()[0] or 0
    return max(1, -(-size // block_chars))


def find_terms(rows: DataFrame, text: str, terms: DataFrame, form: str, into: str, block_chars: int = TERM_BLOCK) -> DataFrame:
    """rows with the column `into`: for each of them the terms (all columns but `form`, as structs, in no particular order)
    whose form its text contains. Forms are taken as they are; null and empty ones are passed over. A null text has none;
    terms that are repeated are found repeatedly. Without terms every row gets an empty array.
    """
    terms = stored(terms.filter(F.length(form) > 0), "terms")
    n = _blocks(terms, form, block_chars)
    kind = StructType([f for f in terms.schema.fields if f.name != form])
    names = rows.columns
    out = rows
    for k in range(n):
        table = (terms if n == 1 else terms.filter(F.pmod(F.xxhash64(form), F.lit(n)) == k)).toArrow()
        forms = table.column(form).to_pylist()
        structs = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in kind.names], names=kind.names)
        into_k = into if n == 1 else f"{into}_{k}"
        out = _found(out, text, forms, structs, StructType([*out.schema.fields, StructField(into_k, ArrayType(kind))]))
        if n > 1:  # one block's automaton at a time
            every = F.col(into_k) if k == 0 else F.concat(into, into_k)
            out = stored(out.select(*names, every.alias(into)), "terms-found")
    return out


def _found(rows: DataFrame, text: str, forms: list[str], structs: pa.StructArray, schema: StructType) -> DataFrame:
    name, at = uuid.uuid4().hex, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, forms) if forms else None
        for batch in batches:
            found, sizes = [], np.zeros(batch.num_rows + 1, dtype=np.int32)
            for k, t in enumerate(batch.column(at).to_pylist() if automaton else ()):
                if t:
                    mine = {p for _, places in automaton.iter(t) for p in places}
                    found += mine
                    sizes[k + 1] = len(mine)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), structs.take(pa.array(found, pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return rows.mapInArrow(run, schema)
