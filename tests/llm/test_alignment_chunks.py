"""Texts that both tokenizers cut alike are cut once; words in a row have the ids of single words."""

from hypothesis import example, given, settings
from hypothesis import strategies as st

from plumbline.llm import alignment, queries, token_counts

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from(list(" \n\t\r\x0b\x0c\xa0 ▁abé.'1中")), min_size=1, max_size=30)
aligner = alignment.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(TEXT)
@example("a\n\nb")
@example("a \n b")
@example("a  b")
def test_shared_chunks_are_those_of_both(text):
    chunks = aligner.one.tokenizer.chunks(text)
    if all(alignment._SHARED.fullmatch(c) for c in chunks):
        assert [c.encode() for c in chunks] == token_counts.pre_tokens(text.encode())


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_ids_are_those_of_the_libraries(texts):
    (a, n_a, _), (b, n_b, _) = aligner._encode(texts)
    one = [aligner.one.tokenizer.tool.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert a.tolist() == [i for x in one for i in x] and n_a.tolist() == [len(x) for x in one]
    two = [aligner.two.encode([t]) for t in texts]
    assert b.tolist() == [i for x in two for i in x[0].tolist()] and n_b.tolist() == [x[1][0] for x in two]


def test_words_in_a_row_have_their_own_ids():
    words = [f" w{i}'s{i % 7}é." for i in range(450)] + ["x", "\n", " \xa0y", " z"]
    ids, sizes = aligner.one.tokenizer.encode(words)
    single = [aligner.one.tokenizer.tool.encode(w, add_special_tokens=False).ids for w in words]
    assert ids.tolist() == [i for x in single for i in x] and sizes.tolist() == [len(x) for x in single]


def test_ordinary_texts_are_looked_up_once():
    own = alignment.Aligner(A, B)
    found = own.align(["two words\nand more", "", "again two words."])
    assert len(own.one.known) and not own.two.known and found.n_a[0] > 3
    own.align(["two  words"])
    assert own.two.known
