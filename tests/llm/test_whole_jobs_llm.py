"""Conversations and notices of any length: nothing cut off or judged in pieces."""

import textwrap

import pytest

from vellumspark.llm import chat, licenses


def _templates():
    """By name; nested, so that they are sent to the workers by value."""

    def system_last(turns):
        """The first turn's text goes into the last user turn."""
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"<{r}>{turns[0][1] + ' ' if i == last else ''}{t}" for i, (r, t) in enumerate(turns))

    def tenth_in_every(turns):
        """Every turn opens with its own number and the tenth turn's text; nothing is rewritten."""
        return "".join(f"<{i}:{turns[9][1] if i > 9 else ''}>{t}" for i, (_, t) in enumerate(turns))

    return {"system_last": system_last, "tenth_in_every": tenth_in_every}


@pytest.mark.parametrize("name", ["system_last", "tenth_in_every"])
def test_long_conversations_are_true_prefixes(spark, name):
    template = _templates()[name]
    turns = [("system" if i == 0 else "user" if i % 2 else "assistant", f"text {i}") for i in range(200)]
    df = spark.createDataFrame([(c, i, r, t) for c, n in ((1, 200), (2, 64), (3, 65)) for i, (r, t) in enumerate(turns[:n])], "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df, template).toPandas().sort_values(["conv", "position"])
    for c, n in (("c1", 200), ("c2", 64), ("c3", 65)):
        own = got[got.conv == c]
        assert list(zip(own.span, own.rewrites, own.loss_start, own.loss_end, strict=True)) == chat.spans(turns[:n], template)


def test_wrapped_notices_are_confirmed_once(spark):
    model = licenses.train(spark)
    gpl, mit, bsd = licenses.TEMPLATES["gpl"][1], licenses.TEMPLATES["mit"][2], licenses.TEMPLATES["bsd"][2]
    fold = lambda text, width, lead="": "\n".join(lead + x for x in textwrap.wrap(text, width))
    prose = "The river was quiet and the boats lay at the pier all day."
    texts = [
        f"{prose}\n{fold(gpl, 75)}\n{prose}", f"{prose}\n\n{fold(mit, 70, '# ')}\n#\n# {prose}", fold(bsd, 72), f"{fold(mit, 40)}\n{fold(mit, 78)}",
        "\n".join(mit.split(" ")), mit.replace(" to any", "\n\nto any").replace(" software and", "\n\nsoftware and"), f"{prose}\n{mit}\n{prose}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs, model).where("confirmed").collect())
    second = len(textwrap.wrap(mit, 40))
    assert found == [(0, 1, "gpl"), (1, 2, "mit"), (2, 0, "bsd"), (3, 0, "mit"), (3, second, "mit"), (4, 0, "mit"), (6, 1, "mit")]
