"""Byte-pair encoding against the tokenizers library."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from canvass.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def texts(seed, many):
    draw = random.Random(seed)
    odd = [chr(c) for c in [*range(0, 0x180), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0x4E2D, 0x1F600, 0x301, 0xFEFF, 0x660, 0xB2]]
    for _ in range(many):
        letters = odd if draw.random() < 0.5 else list(" 'stvemldre\n  aeiou12thing")
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        yield text + draw.choice(["", "", "<|endoftext|>" + text, "<|endoftext|><|endoftext|>"])


def test_ids_and_texts_are_those_of_the_library(library, vocabulary):
    for text in texts(1, 4000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(vocabulary.encode(text)) == ids
        assert vocabulary.decode(vocabulary.encode(text)).decode() == library.decode(ids, skip_special_tokens=False) == text


def test_strings_of_tokens(library, vocabulary):
    """Every token that is a text, also those that merging never reaches."""
    for data in vocabulary.bytes[::7]:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        assert list(vocabulary.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    before = [list(vocabulary.encode(t)) for t in texts(2, 200)]
    for memory in (vocabulary.words, vocabulary.pieces, vocabulary.after):
        memory.clear()
        monkeypatch.setattr(memory, "most", 3)
        assert [list(vocabulary.encode(t)) for t in texts(2, 200)] == before
        assert len(memory) <= 3


def test_what_is_asked_for_again_is_remembered():
    asked = []
    memory = bpe.Remembered(lambda x: asked.append(x) or len(x), 2)
    for key in ("a", "bb", "a", "ccc", "a", "dddd", "a", "e", "a"):
        assert memory[key] == len(key)
    assert asked.count("a") == 1 and len(memory) <= 2 and len(memory.older) <= 2


def test_two_vocabularies_of_one_name(spark, tmp_path, library):
    with open(PATH, encoding="utf-8") as file:
        whole = json.load(file)
    fewer = json.loads(json.dumps(whole))
    gone = {"".join(m.split(" ") if isinstance(m, str) else m) for m in fewer["model"]["merges"][2000:]}
    fewer["model"]["merges"] = fewer["model"]["merges"][:2000]
    fewer["model"]["vocab"] = {t: i for t, i in whole["model"]["vocab"].items() if t not in gone}
    rows = spark.createDataFrame([(1, "Several words of a longer sentence, spelt out.")], "doc_id long, text string")
    found = []
    for folder, content in (("one", whole), ("two", fewer)):
        (tmp_path / folder).mkdir()
        path = tmp_path / folder / "vocabulary.json"
        path.write_text(json.dumps(content), encoding="utf-8")
        text = rows.first()["text"]
        found.append(bpe.bpe(rows, str(path)).first()["ids"])
        assert found[-1] == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert found[0] != found[1]


def test_a_table_of_odd_rows(spark, library):
    given = [None, "", "a" * 5000, "  two  blanks \n", "<|endoftext|>", *texts(3, 40)]
    rows = spark.createDataFrame([(i % 30, t, "clash", 7) for i, t in enumerate(given)], "doc_id long, text string, ids string, decoded int")
    got = bpe.bpe(rows, PATH).collect()
    wanted = [(i % 30, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in enumerate(given)]
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in got) == sorted(wanted)
    assert bpe.bpe(rows.limit(0), PATH).count() == 0


def test_other_kinds_of_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        bpe.Vocabulary(file.read())
