import pytest

from pagestrata.functions.markup import Reader

CASES = {
    "<p>a<p>b": "<p>a</p><p>b</p>",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>",
    "<table><td>a<td>b<tr><th>c</table>d": "<table><tbody><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></tbody></table>d",
    "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
    "<select><option>a<option>b</select>": "<select><option>a</option><option>b</option></select>",
    "<DIV ID=x Class='a b' hidden>t</DIV>": '<div id="x" class="a b" hidden="">t</div>',
    "<img src=a.png><br/>x": '<img src="a.png"/><br/>x',
    "<p><b>a<p>b</b>c": "<p><b>a</b></p><p><b>b</b>c</p>",
    "<p><b><b><b><b>a<p>b": "<p><b><b><b><b>a</b></b></b></b></p><p><b><b><b>b</b></b></b></p>",
    '<script>var t="</p>";</script><p>a': '<script>var t="</p>";</script><p>a</p>',
    "a<!-- <p> -->b": "a<!-- <p> -->b",
    "&copy;&amp;&lt;&#65;&nbsp": "©&amp;&lt;A ",
    "<h1>a<h2>b</h2>": "<h1>a</h1><h2>b</h2>",
    "a</p>b": "a<p></p>b",
    "<a href=1>x<a href=2>y": '<a href="1">x</a><a href="2">y</a>',
    "</div>a</b>": "a",
    "": "",
}


@pytest.mark.parametrize("source", CASES)
def test_canonical_markup(source):
    assert Reader().read(source).canon == CASES[source]


def test_offsets_cut_what_they_say():
    reader = Reader().read("<div>ü<p>a<b>b</div>c<ul><li>d<li>e")
    for n in reader.nodes:
        outer = reader.canon[n.html_start : n.html_end]
        assert outer.startswith(f"<{n.tag}") and outer.endswith(f"</{n.tag}>")
        assert reader.canon[n.inner_start : n.inner_end] in outer
        below = [m for m in reader.nodes if n.html_start < m.html_start < n.html_end]
        assert n.last_desc_id == (below[-1].node_id if below else n.node_id)
    assert reader.text == "üabcde"


def test_digests_are_equal_where_markup_is():
    html = "<div><p>a<b>x</b></p><p>a<b>x</b></p><p>ab<b></b></p><p><b>x</b>a</p><!--c--><i><img src=1></i><i><img src=2></i><i><img src=1></i></div><p>a<b>x"
    reader = Reader().read(html)
    by_digest, by_markup = {}, {}
    for n in reader.nodes:
        by_digest.setdefault(n.digest, []).append(n.node_id)
        by_markup.setdefault(reader.canon[n.html_start : n.html_end], []).append(n.node_id)
    assert list(by_digest.values()) == list(by_markup.values()) and all(len(d) == 16 for d in by_digest)
    assert len(by_markup) < len(reader.nodes)
