"""The registered operators beside their SQL, and the pipeline stage by stage."""

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from canvass.llm import decontaminate as leaks
from canvass.llm import near_dedup as near
from canvass.llm.queries import ORACLES, QUERIES
from check import TABLES, compare
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_operator_equals_sql(spark, connection, name):
    verdict, count, _ = compare(spark, connection, SMALL, name)
    assert verdict == ("ok" if name in ORACLES else "rows only")
    assert count > 0 or name == "op10_decontaminate"


def test_pipeline(spark):
    """Each stage is held against what it says of its own input."""
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SMALL).cache())
    start, clean, distinct, cut, safe, coded = ({r["doc_id"]: r for r in f.collect()} for f in frames)
    assert all(f.columns == columns for f in frames[1:-1])
    assert len(clean) < len(start) and all(clean[i] == start[i] for i in clean)
    # one of each group stays, with its row as it was
    sets = {i: set(near.set_of(r["text"] or "", 5).tolist()) for i, r in clean.items()}
    for i in clean.keys() - distinct.keys():
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in clean if j < i)
    for i in distinct:
        assert not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in distinct if j < i and sets[i])
        assert distinct[i] == clean[i]
    # no window of twenty words occurs twice, unless cutting brought it together
    assert cut.keys() == distinct.keys()
    seen, repeated = set(), set()
    for i in sorted(distinct):
        words = distinct[i]["text"].encode().split()
        gone = set()
        for p in range(len(words) - 19):
            window = tuple(words[p:p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.add(window)
        repeated |= {i} if gone else set()
        assert cut[i]["text"] == b" ".join(w for p, w in enumerate(words) if p not in gone).decode()
        assert cut[i]["n_chars"] == len(cut[i]["text"]) and cut[i]["source"] == start[i]["source"]
    assert repeated
    items = [(r["item_id"], leaks.normal(r["text"])) for r in corpus_pipeline.table(spark, SMALL, "benchmark").collect()]
    known = leaks.Items(items, leaks.RATE)
    assert safe.keys() == {i for i, r in cut.items() if not known.found_in(leaks.normal(r["text"]))}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert coded.keys() == safe.keys()
    for i, r in coded.items():
        assert r["ids"] == library.encode(safe[i]["text"], add_special_tokens=False).ids
        assert r["text"] == safe[i]["text"] and r["n_tokens"] == len(r["ids"])


def test_run_writes_all_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "ids", "n_tokens", "text"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
