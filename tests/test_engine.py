"""Parsers, patterns, shapes, reduction and annotation on small graphs of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from graphqa import api
from graphqa.config import Config
from graphqa.operators.validate import NonStratifiedSchema, Validator
from graphqa.plans import reduce as red
from graphqa.plans.compile import Compiler
from graphqa.plans.shapes import Constraint, Shape, shape_from_json, shapes_from_graph
from graphqa.plans.sparql import parse
from graphqa.sources.endpoint import check_url, read_endpoint
from graphqa.sources.store import TripleStore
from graphqa.sources.turtle import parse_rdfxml, parse_turtle, read_rdf, triples_of

NS = "http://ex.org/"
HEAD = f"@prefix : <{NS}> .\n@prefix sh: <http://www.w3.org/ns/shacl#> .\n"
PREFIX = f"PREFIX : <{NS}>\n"

# Three rings of a cycle A -> C -> D -> A; beta is present on some nodes only.
RING = HEAD + """
:A0 a :A ; :alpha :C0, :C1 ; :beta "1" . :A1 a :A ; :alpha :C1 . :A2 a :A ; :alpha :C2 ; :beta "1" .
:C0 a :C ; :alpha :D0 . :C1 a :C ; :alpha :D1 . :C2 a :C .
:D0 a :D ; :alpha :A0 . :D1 a :D ; :alpha :A1 ; :beta "1" . :D2 a :D ; :alpha :A2 ; :beta "1" .
"""


def ring_shapes(beta_on="AD"):
    out = []
    for a, b in (("A", "C"), ("C", "D"), ("D", "A")):
        cs = [Constraint("min", NS + "alpha", n=1, ref=b)]
        if a in beta_on:
            cs.append(Constraint("min", NS + "beta", n=1))
        out.append(Shape(a, NS + a, constraints=tuple(cs)))
    return out


def verdicts(store, shapes, names=None):
    return {(r.instance.replace(NS, ""), r.shape): (r.valid, r.reason) for r in Validator(store, shapes).facts(names).collect()}


@pytest.fixture(scope="module")
def ring(spark):
    return TripleStore(triples_of(spark, RING))


def run(store, text):
    return sorted(tuple(None if x is None else x.replace(NS, "") for x in r) for r in Compiler(store).run(parse(PREFIX + text)).collect())


def test_turtle_forms():
    t = parse_turtle(HEAD + ':a :p "x"@en, "1"^^:t, 5, 1.5, true, [ :q ( :b :c ) ] ; :r \'it\\\'s\' . # end\n')
    kinds = {(x[2], x[4], x[5]) for x in t if x[1] == NS + "p"}
    assert ("x", "", "en") in kinds and ("1", NS + "t", "") in kinds and len([x for x in t if x[1].endswith("first")]) == 2
    assert ("it's") in {x[2] for x in t}


def test_rdfxml():
    xml = f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="{NS}" xml:base="http://b/">
    <e:T rdf:about="{NS}a"><e:p rdf:resource="#r"/><e:q>v</e:q><e:in><e:U rdf:ID="u"/></e:in></e:T></rdf:RDF>"""
    t = {x[:3] for x in parse_rdfxml(xml)}
    assert (NS + "a", NS + "p", "http://b/#r") in t and (NS + "a", NS + "q", "v") in t and (NS + "a", NS + "in", "http://b/#u") in t


def test_ntriples(spark, tmp_path):
    (tmp_path / "g.nt").write_text(f'<{NS}a> <{NS}p> "x\\"y"@en .\n<{NS}a> <{NS}p> <{NS}b> .\n# note\n')
    rows = {(r.o, r.o_kind, r.o_lang) for r in read_rdf(spark, str(tmp_path / "g.nt"), "ntriples").collect()}
    assert rows == {('x"y', "literal", "en"), (NS + "b", "iri", "")}
    (tmp_path / "h.nt").write_text(f'<{NS}a> <{NS}p> "C:\\\\new\\t\\u00e9\\U0001F600"^^<{NS}t> .\n\n')
    assert [(r.o, r.o_dt) for r in read_rdf(spark, str(tmp_path / "h.nt"), "ntriples").collect()] == [("C:\\new\t\u00e9\U0001F600", NS + "t")]
    (tmp_path / "bad.nt").write_text(f"<{NS}a> <{NS}p> .\n")
    with pytest.raises(Exception, match="unreadable N-Triples line"):
        read_rdf(spark, str(tmp_path / "bad.nt"), "ntriples").collect()


def test_patterns(ring):
    assert run(ring, "SELECT ?x WHERE { ?x a :A . ?x :beta '1' }") == [("A0",), ("A2",)]
    assert run(ring, "SELECT ?x ?y WHERE { ?x a :C . OPTIONAL { ?x :alpha ?y } }") == [("C0", "D0"), ("C1", "D1"), ("C2", None)]
    assert run(ring, "SELECT ?x ?y ?b WHERE { ?x a :C OPTIONAL { ?x :alpha ?y } ?y :beta ?b }") == run(ring, "SELECT ?x ?y ?b WHERE { { ?x a :C . ?x :alpha ?y . ?y :beta ?b } UNION { VALUES ?x { :C2 } ?y :beta ?b } }")
    assert run(ring, "SELECT ?x ?k WHERE { ?x a :A OPTIONAL { ?x :none ?k } OPTIONAL { ?x :alpha ?k . ?k a :C FILTER(?k != :C1) } }") == [("A0", "C0"), ("A1", None), ("A2", "C2")]
    assert run(ring, "SELECT ?x WHERE { ?x a :A MINUS { ?x :beta ?b } }") == [("A1",)]
    assert run(ring, "SELECT ?x WHERE { ?x a :A MINUS { ?q :beta ?b } }") == [("A0",), ("A1",), ("A2",)]
    assert run(ring, "SELECT ?x WHERE { ?x a :A FILTER NOT EXISTS { ?x :beta ?b } }") == [("A1",)]
    assert run(ring, "SELECT ?x WHERE { ?x a :A FILTER(EXISTS { ?x :alpha ?c . ?c :alpha ?d } && ?x != :A1) }") == [("A0",)]
    assert run(ring, "SELECT ?x ?n WHERE { ?x a :C OPTIONAL { ?x :alpha ?y } BIND(IF(BOUND(?y), 'yes', 'no') AS ?n) }") == [("C0", "yes"), ("C1", "yes"), ("C2", "no")]
    assert run(ring, "SELECT ?x ?z WHERE { ?x a :A . ?x :alpha/:alpha/^:alpha ?z }") == [("A0", "C0"), ("A0", "C1"), ("A1", "C1")]
    assert run(ring, "SELECT DISTINCT ?a ?b WHERE { ?x :alpha ?a . ?x :alpha ?b . FILTER(?a != ?b) }") == [("C0", "C1"), ("C1", "C0")]
    assert run(ring, "SELECT ?x WHERE { ?x ^:alpha :A0 }") == [("C0",), ("C1",)]
    assert run(ring, "SELECT ?x WHERE { VALUES ?x { :A0 :D2 } ?x :beta ?b }") == [("A0",), ("D2",)]
    assert run(ring, "SELECT ?x WHERE { { ?x a :A } UNION { ?x a :D } } ORDER BY ?x LIMIT 2 OFFSET 2") == [("A2",), ("D0",)]
    assert run(ring, "SELECT ?x WHERE { { SELECT ?x WHERE { ?x a :A } } { SELECT ?x WHERE { ?x :beta ?b } } }") == [("A0",), ("A2",)]
    assert run(ring, "SELECT ?p WHERE { :D1 ?p ?o . FILTER(isLiteral(?o)) }") == [("beta",)]
    assert Compiler(ring).run(parse(PREFIX + "ASK { :A9 ?p ?o }")).first()[0] is False


def test_query_questions():
    q = parse(PREFIX + "SELECT ?n WHERE { ?x a :A . ?x :alpha ?n . OPTIONAL { ?x :beta ?b } # note\n FILTER(?b = 'it''s' || ?b > 3) }".replace("'it''s'", '"it\'s"'))
    assert q.target_var() == "x" and q.variables() == ["x", "n", "b"] and [t.optional for t in q.triples()] == [False, False, True]
    assert q.vars_of_predicate(NS + "alpha") == ["n"]
    assert parse(q.text()).where == q.where
    star = parse(PREFIX + "SELECT ?n WHERE { :A0 :alpha ?n }").make_star()
    assert star.target_var() == "x" and star.projection() == ["x", "n"]
    assert parse(PREFIX + "SELECT ?n WHERE { ?a :p ?b . ?b :q ?n }").make_star() is None


def test_intersection_renames(ring):
    a = parse(PREFIX + "SELECT ?v WHERE { ?v a :A . ?v :alpha ?x }")
    b = parse(PREFIX + "SELECT ?x WHERE { ?x :beta ?v }")
    both = a.intersect(b)
    assert both.is_plain() and both.select == ("x",)
    assert run(ring, "SELECT ?x WHERE { ?x a :A }") != [] and sorted(r[0].replace(NS, "") for r in Compiler(ring).run(both).collect()) == ["A0", "A2"]
    nested = parse(PREFIX + "SELECT ?x WHERE { { ?x a :A } UNION { ?x a :D } }")
    assert not a.intersect(nested).is_plain()
    assert sorted(r[0].replace(NS, "") for r in Compiler(ring).run(a.intersect(nested)).collect()) == ["A0", "A1", "A2"]


def test_greatest_fixpoint(ring):
    v = verdicts(ring, ring_shapes(""))
    assert {k[0] for k, x in v.items() if x[0]} == {"A0", "A1", "C0", "C1", "D0", "D1"}  # A2 -> C2 leads nowhere, D2 -> A2
    full = verdicts(ring, ring_shapes("AD"))
    assert {k[0] for k, x in full.items() if x[0]} == set()
    assert verdicts(ring, ring_shapes("D"))[("A1", "A")][0] is True


def test_negation_in_a_cycle_is_refused(ring):
    shapes = [Shape("A", NS + "A", constraints=(Constraint("max", NS + "alpha", n=0, ref="C"),)), Shape("C", NS + "C", constraints=(Constraint("min", NS + "alpha", inverse=True, n=1, ref="A"),))]
    with pytest.raises(NonStratifiedSchema):
        Validator(ring, shapes).facts().collect()


def test_shapes_from_turtle(ring):
    text = HEAD + """
    :S a sh:NodeShape ; sh:targetClass :A ;
      sh:property [ sh:path :alpha ; sh:minCount 1 ; sh:maxCount 1 ] ;
      sh:property [ sh:path [ sh:inversePath :alpha ] ; sh:qualifiedValueShape [ sh:node :R ] ; sh:qualifiedMinCount 1 ] ;
      sh:or ( [ sh:path :beta ; sh:minCount 1 ] [ sh:path :gamma ; sh:minCount 1 ] ) .
    :R a sh:NodeShape .
    """
    s, r = shapes_from_graph(parse_turtle(text))
    assert [c.kind for c in s.constraints] == ["min", "max", "min", "or"] and s.constraints[2].inverse and s.references() == {NS + "R": "^" + NS + "alpha"}
    assert not r.has_target
    v = verdicts(ring, [s, r], [s.id])
    assert v[("A0", s.id)] == (False, s.id) and v[("A1", s.id)][0] is False and v[("A2", s.id)] == (True, s.id)


def test_json_shape():
    s = shape_from_json({"name": "D", "prefix": {"e": f"<{NS}>"}, "targetDef": {"class": "e:A"}, "constraintDef": {"conjunctions": [[{"path": "e:p", "min": 1, "max": 2}, {"path": "^e:q", "max": 0, "shape": "X"}, {"path": "e:r", "min": 1, "value": "e:v"}]]}})
    assert [(c.kind, c.n, c.ref, c.inverse) for c in s.constraints] == [("min", 1, None, False), ("max", 2, None, False), ("max", 0, "X", True), ("min", 1, None, False)]
    assert s.constraints[3].value == NS + "v" and s.target_class == NS + "A"


def test_closed_membership(spark):
    g = TripleStore(triples_of(spark, HEAD + ":b1 a :B ; :to :c1, :x1 . :b2 a :B ; :to :c1 . :c1 a :C ."))
    one = Constraint("max", NS + "to", n=1, ref="C")
    v = verdicts(g, [Shape("B", NS + "B", constraints=(one,)), Shape("C", NS + "C")], ["B"])
    assert v[("b1", "B")][0] is True  # x1 is no target of C and so no member


def test_reduction():
    def leaf(p, kind="min", n=1, ref=None, inverse=False):
        return Constraint(kind, NS + p, inverse, n, ref)

    a = Shape("A", NS + "A", constraints=(Constraint("or", options=(leaf("p0"), leaf("p1", n=3), leaf("p2", "max", 0, inverse=True))), leaf("p3"), leaf("to", ref="B")))
    b, c = Shape("B", NS + "B", constraints=(leaf("back", ref="A"), leaf("own"))), Shape("C", NS + "C")
    q = lambda body: parse(PREFIX + f"SELECT ?x WHERE {{ ?x a :A . {body} }}")
    assert red.remove_constraints([a], ["A"], q("?x :p0 ?v"))[0].constraints == (leaf("p0"),)
    two = red.remove_constraints([a], ["A"], q("?x :p0 ?v . ?x ^:p2 ?w"))[0].constraints
    assert two[0].kind == "or" and len(two[0].options) == 2
    assert red.remove_constraints([a], ["A"], q("?x :p2 ?v"))[0].constraints == ()  # the direction counts
    kept = red.remove_constraints([a, b, c], ["A"], q("?x :to ?b"))
    assert [s.constraints for s in kept] == [(leaf("to", ref="B"),), (leaf("own"),), ()]
    assert red.node_order([a, b, c], ["A"]) == ["A", "B"] and [s.id for s in red.prune([a, b, c], ["C"])] == ["C"]
    assert red.overlap([a, b, c], "A", "C") == 0.0 and red.overlap([a, b, c], "A", "B") == 1.0
    assert red.unify_target_shape({"?X": "<S>"}, None) == {"x": ["S"]} and red.unify_target_shape("S", None) == {"UNDEF": ["S"]}


def test_annotation_end_to_end(ring):
    options = {"query": PREFIX + "SELECT ?x ?y WHERE { ?x a :A . ?x :alpha ?y . OPTIONAL { ?x :beta ?b } }", "schema_dir": ring_shapes(""), "targetShape": {"?x": "A"}, "write_stats": False}
    rows = {(r["bindings"]["x"].replace(NS, ""), r["bindings"]["y"].replace(NS, "")): r for r in api.answers(ring, options)}
    assert set(rows) == {("A0", "C0"), ("A0", "C1"), ("A1", "C1"), ("A2", "C2")}
    assert len(rows["A1", "C1"]["triples"]) == 2 and len(rows["A0", "C0"]["triples"]) == 3  # unbound ?b gives no triple
    assert {(t["p"], t["o"]) for t in rows["A2", "C2"]["report"] if t["s"].endswith(":A2")} == {("ts:violatesShape", "A")}
    test = api.annotated(ring, options | {"output_format": "test", "collect_all_validation_results": True})
    assert sorted((r.bucket, r.instance.replace(NS, "")) for r in test.collect() if r.bucket.endswith("Targets")) == [("invalidTargets", "A2"), ("validTargets", "A0"), ("validTargets", "A1")]
    assert api.validate_only(ring, options, detail=False).where("shape = 'A'").first().invalid == 1
    assert api.reduced_names({"schema_dir": ring_shapes(), "targetShape": "C"}) == ["C", "D", "A"]


def test_config():
    c = Config.from_dict({"config": {"targetShape": "S", "remove_constraints": "true"}, "maxSplit": 9})
    assert c.target_shape == "S" and c.remove_constraints is True and c.max_split == 9
    for wrong in ({"remove_constraints": True, "prune_shape_network": False}, {"backend": "s2spy", "start_with_target_shape": False}, {"reasoning": "maybe"}, {"use_pipes": True, "run_in_serial": True}):
        with pytest.raises(ValueError):
            Config.from_dict(wrong)


class _Fake(BaseHTTPRequestHandler):
    def do_GET(self):
        query = parse_qs(urlsplit(self.path).query)["query"][0]
        rows = [{"x": {"type": "uri", "value": f"{NS}{k}"}, "v": {"type": "typed-literal", "value": "true", "datatype": "d"}} for k in range(5)]
        if "LIMIT" in query:
            n, k = int(query.split()[-3]), int(query.split()[-1])
            rows = rows[k : k + n]
        body = json.dumps({"head": {"vars": ["x", "v", "u"]}, "results": {"bindings": rows}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_endpoint(spark):
    server = HTTPServer(("127.0.0.1", 0), _Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/sparql"
    for page, total in ((0, 0), (2, 0), (2, 5)):
        rows = read_endpoint(spark, url, "SELECT *", ["x", "v", "u"], page, total).collect()
        assert sorted(r.x[-1] for r in rows) == list("01234") and rows[0].v == "true^^<d>" and rows[0].u is None
    server.shutdown()
    with pytest.raises(ValueError):
        check_url("ftp://x")
