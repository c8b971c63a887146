"""op6: pages whose optional </head> is left out."""

import pytest

from mosaica.llm import html_extract

TEXT = "A first sentence, and more of it."


def _texts(page: str) -> list[str]:
    return [b[0] for b in html_extract.blocks(page)]


@pytest.mark.parametrize("start", ["<body>", "<BODY class=x>", "<article>", "<a href=x>", ""])
def test_head_ends_where_the_body_begins(start):
    assert _texts(f"<html><head><title>T</title><meta charset=utf-8>\n{start}{TEXT}</html>") == [TEXT]


def test_head_itself_stays_silent():
    head = "<title>T</title><style>p {}</style>\n<script>x</script><noscript><p>n</p></noscript><template><p>t</p></template><link href=x>"
    assert _texts(f"<html><head>{head}</head><body><p>{TEXT}</p></body></html>") == [TEXT]
    assert _texts(f"<html><head>{head}<body><p>{TEXT}</p></body></html>") == [TEXT]
