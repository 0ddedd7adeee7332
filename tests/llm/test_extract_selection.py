"""Which blocks of a page are its article."""

from meterline.llm import extract

P = ("A sentence of the text, with some words in it, goes on for a while. " * 4).strip()


def test_title_and_lead_outside_the_largest_part():
    body = "".join(f"<p>{P}</p>" for _ in range(12))
    page = f'<div id="content"><h1>Title</h1><p class="lead">The lead, in a sentence or two, of the text.</p><div class="body">{body}</div></div>'
    assert extract.main_text(page).split("\n\n") == ["Title", "The lead, in a sentence or two, of the text.", *[P] * 12]


def test_content_in_several_parts():
    page = "".join(f"<div><h2>Part {i}</h2><div>{f'<p>{P}</p>' * n}</div></div>" for i, n in enumerate((11, 1)))
    got = extract.main_text(f"<body>{page}</body>").split("\n\n")
    assert got == ["Part 0", *[P] * 11, "Part 1", P]


def test_link_lists_without_a_class_go():
    links = "".join(f'<li><a href="/{i}">A link to page {i}</a></li>' for i in range(6))
    for tag in ("article", "div"):
        page = f"<{tag}><p>{P}</p><ul>{links}</ul><p>{P}</p><p>Short.</p><p>{P}</p></{tag}>"
        assert extract.main_text(page).split("\n\n") == [P, P, "Short.", P]
