"""Tokenizer files of other make, and decoding from ids alone."""

import json
import struct

import pytest

from docwarden.llm import op09_bpe

OTHERS = {
    "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}


@pytest.fixture(scope="module")
def given():
    with open(op09_bpe.default_path(), encoding="utf-8") as file:
        return json.load(file)


@pytest.mark.parametrize("name", OTHERS)
def test_file_with_another_component_is_refused(tmp_path, given, name):
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given | {name: OTHERS[name]}))
    with pytest.raises(ValueError, match=name):
        op09_bpe.WordBpe(str(path))


@pytest.mark.parametrize(("name", "value"), [("byte_fallback", True), ("dropout", 0.1), ("unk_token", "<unk>"), ("ignore_merges", True)])
def test_file_with_another_model_is_refused(tmp_path, given, name, value):
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given | {"model": given["model"] | {name: value}}))
    with pytest.raises(ValueError, match=f"model.{name}"):
        op09_bpe.WordBpe(str(path))


def test_added_token_that_strips_is_refused(tmp_path, given):
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given | {"added_tokens": [{**given["added_tokens"][0], "lstrip": True}]}))
    with pytest.raises(ValueError, match="added token"):
        op09_bpe.WordBpe(str(path))


def test_decoding_needs_nothing_but_ids():
    tokenizers = pytest.importorskip("tokenizers")
    known, model = tokenizers.Tokenizer.from_file(op09_bpe.default_path()), op09_bpe.WordBpe(op09_bpe.default_path())
    size = known.get_vocab_size()
    lists = [[], [0], [size - 1], list(range(size)), [5, 5, 5], list(range(size - 1, -1, -7))]
    for ids in lists:
        assert model.decode(struct.pack(f"<{len(ids)}I", *ids)) == known.decode(ids, skip_special_tokens=False)
    got = model.decode_lists(op09_bpe.id_lists([struct.pack(f"<{len(ids)}I", *ids) for ids in lists])).to_pylist()
    assert got == [known.decode(ids, skip_special_tokens=False) for ids in lists]
    with pytest.raises(IndexError):
        model.decode(struct.pack("<I", size))
