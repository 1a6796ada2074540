import itertools
import zlib

import numpy as np
import pytest

from lumenquery.llm import quality as Q, toxicity as T
from lumenquery.session import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def held_out_accuracy(out, labels, column, modulus, remainder):
    y = {r.doc_id: r[column] for r in labels.collect()}
    rows = [r for r in out.collect() if r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    held = [r for r in rows if r.held_out]
    return np.mean([r.predicted == y[r.doc_id] for r in held])


def test_toxicity_held_out(tables):
    docs, labels = tables
    assert held_out_accuracy(T.scored(docs, labels), labels, "toxic", 4, 2) > 0.9


def test_quality_held_out(tables):
    docs, labels = tables
    assert held_out_accuracy(Q.scored(docs, labels), labels, "quality", 5, 0) > 0.9


def test_restored_words(spark):
    rows = [(i, "the stupid idiot is a loser and a moron they say") for i in range(40)]
    cost = T.char_model(spark.createDataFrame(rows, "doc_id long, text string"))
    tool = T.Restorer(cost)
    for shown, hidden in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("stuuupid", "stupid"), ("m0r0n!!", "moron"), ("St​upid", "stupid")):
        assert hidden in tool.words(shown), shown
    for shown, hidden in (("!diot", "idiot"), ("(an you", "can"), ("\"!diot,\"", "idiot")):
        assert hidden in T.Restorer(T.char_model(spark.createDataFrame([*rows, *((i, "you can if they can") for i in range(40, 80))], "doc_id long, text string"))).words(shown), shown
    assert tool.words("plain words stay") == {"plain", "words", "stay"} and tool.words("") == set()


def price(spellings, cost):
    a = b = 0
    total = 0.0
    for ch in "".join(s for s, _ in spellings):
        z = int(T._CODE[ord(ch)])
        total += cost[a][b][z]
        a, b = b, z
    return total + cost[a][b][0] + sum(p for _, p in spellings)


@pytest.mark.parametrize("word", ["1d10t", "f*ol", "l.o-s", "stuuupid", "m0r0n", "!!a", "a  b", "$$h|t", "4", "éé1"])
def test_decoding_equals_all_spellings(word):
    """Viterbi against every way to spell a short lattice."""
    cost = np.random.default_rng(len(word)).exponential(2.0, (T.SIGNS,) * 3).tolist()
    ways = list(itertools.product(*T.lattice(word)))
    best = min(price(w, cost) for w in ways)
    got = T.decode(word, cost)
    assert abs(min(price(w, cost) for w in ways if "".join(s for s, _ in w) == got) - best) < 1e-6


def test_long_tokens_are_decoded_whole(spark):
    cost = T.char_model(spark.createDataFrame([(i, "the stupid idiot is a loser") for i in range(40)], "doc_id long, text string"))
    line = "1d10t" * 300  # any window's end would cut a word
    assert "".join(T.Restorer(cost).words(line)).count("idiot") == 300
    assert T.Restorer(cost).words("a.b" * 100_000)


def test_lattice_is_one_path_for_plain_words():
    assert T.lattice("word") == [[(c, 0.0)] for c in "word"]


@pytest.mark.parametrize("module", [T, Q])
def test_odd_rows(module, odd_docs, no_docs, labels, spark):
    out = module.scored(odd_docs, labels).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert module.scored(no_docs, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert module.scored(odd_docs, none).count() == 8


def test_clean_keeps_columns(odd_docs, no_docs, labels):
    model = T.train(odd_docs, labels)
    assert T.clean(odd_docs, model).columns == odd_docs.columns
    assert T.clean(no_docs, model).count() == 0


def test_gradients_follow_the_loss():
    """A step down the analytic gradient of the unit lowers the loss."""
    rng = np.random.default_rng(0)
    docs = [bytes(rng.integers(97, 123, 700).tolist()) for _ in range(20)] + [b"!!ab" * 150 for _ in range(20)]
    y = np.array([1.0] * 20 + [0.0] * 20)
    net = Q.train_network(docs, y, epochs=30)
    z, _ = net.forward(docs)
    assert ((z > 0) == (y > 0)).mean() > 0.95


def test_gradients_equal_differences():
    """Analytic gradients of tables, maxima, means and bias against central differences of the loss."""
    rng = np.random.default_rng(1)
    net = Q.Network(3)
    net.tables = net.tables.astype(np.float64)
    docs = [bytes(rng.integers(97, 123, n).tolist()) for n in (40, 700, 300, 1200)]
    y = np.array([1.0, 0.0, 0.0, 1.0])

    def loss():
        z = net.forward(docs)[0]
        return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y))

    found = Q.gradients(net, docs, y)
    for grad, values in zip(found[:3], (net.tables, net.top, net.mean), strict=True):
        for at in [tuple(rng.integers(0, n) for n in values.shape) for _ in range(10)] + [np.unravel_index(np.abs(grad).argmax(), grad.shape)]:
            kept, step = values[at], 1e-3
            values[at] = kept + step
            up = loss()
            values[at] = kept - step
            down = loss()
            values[at] = kept
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3 + 0.02 * abs(grad[at])
    net.bias += 1e-4
    up = loss()
    net.bias -= 2e-4
    assert abs((up - loss()) / 2e-4 - found[3][0]) < 1e-3


def test_whole_document_counts():
    net = Q.Network()
    a, b = b"word " * 5000, b"word " * 5000 + b"!!!!!!" * 50
    assert net.forward([a])[0][0] != net.forward([b])[0][0]
    both = net.forward([a, b"", b])[0]
    assert np.allclose(both[[0, 2]], [net.forward([a])[0][0], net.forward([b])[0][0]])
