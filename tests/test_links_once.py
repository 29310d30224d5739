"""Links are taken from the pages once."""

from quiltlens.plans import links as P, load_all, registry

DIR = "/root/testdata/sf0.001"


def test_pages_are_read_once_for_the_links(spark, monkeypatch):
    load_all()
    for name in ("link_audit", "chrome_link_score", "href_rewrites"):
        taken = []
        monkeypatch.setattr(P, "links", lambda s, d, f=P.links: taken.append(d) or f(s, d))
        registry.QUERIES[name](spark, DIR)
        assert len(taken) == 1, name
        monkeypatch.undo()
