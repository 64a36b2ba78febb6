"""Imports resolved to files: rules by language, and edges kept up by index runs equal to those of a rebuild."""

from __future__ import annotations

import random

from sparkloom.operators import graph, imports
from sparkloom.operators.indexing import IndexConfig, Store, index_files

FILES = "path string, content string, language string"
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c"}


def frame(spark, tree):
    return spark.createDataFrame([(p, t, LANGUAGES.get(p.rpartition(".")[2])) for p, t in tree.items()], FILES)


def targets(spark, tree):
    df = frame(spark, tree)
    return {(r.path, r.spec): r.target for r in imports.resolved(imports.imports_of(df), df).collect()}


def test_rules(spark):
    tree = {
        "pkg/__init__.py": "from .core import run\n",
        "pkg/core.py": "import os, pkg.util as u\nfrom pkg import util\nfrom . import *\nfrom ..pkg.util import (\n  a,  # why\n  b as c,\n)\n",
        "pkg/util.py": "import core\n",
        "tests/t.py": "from pkg.core import run\nimport core\n",
        "web/src/a.ts": "import x from './b'\nimport './c.js'\nimport type { T } from '../lib'\nconst q = require('@/d')\nexport { z } from 'src/b'\nimport {\n  m,\n} from 'react'\n",
        "web/src/b.tsx": "",
        "web/src/c.js": "",
        "web/lib/index.ts": "",
        "web/d.ts": "",
        "k/src/lib.rs": "mod a;\npub mod b;\n",
        "k/src/a.rs": "use crate::b::{c::D, E, self};\nuse super::b::c;\nuse self::x::Y;\npub(crate) use serde::Serialize as S;\n",
        "k/src/a/x.rs": "use super::super::b::*;\n",
        "k/src/b/mod.rs": "pub mod c;\n",
        "k/src/b/c.rs": "",
        "g/x/a.go": 'package x\nimport "fmt"\nimport y "example.com/m/g/y"\n',
        "g/y/b.go": "package y\n",
        "g/y/a.go": "package y\n",
        "j/com/x/A.java": "import com.x.B;\nimport static com.x.B.f;\nimport java.util.List;\n",
        "j/com/x/B.java": "",
        "c/a.c": '#include "b.h"\n# include <inc/z.h>\n#include <stdio.h>\n',
        "c/b.h": "",
        "c/deep/inc/z.h": "",
        "n.md": "import os",
        "empty.py": None,
    }
    want = {
        "pkg/__init__.py": {".core.run": "pkg/core.py"},
        "pkg/core.py": {"os": None, "pkg.util": "pkg/util.py", ".*": "pkg/__init__.py", "..pkg.util.a": "pkg/util.py", "..pkg.util.b": "pkg/util.py"},
        "pkg/util.py": {"core": "pkg/core.py"},
        "tests/t.py": {"pkg.core.run": "pkg/core.py", "core": None},
        "web/src/a.ts": {"./b": "web/src/b.tsx", "./c.js": "web/src/c.js", "../lib": "web/lib/index.ts", "@/d": "web/d.ts", "src/b": "web/src/b.tsx", "react": None},
        "k/src/lib.rs": {"mod a": "k/src/a.rs", "mod b": "k/src/b/mod.rs"},
        "k/src/a.rs": {"crate::b::c::D": "k/src/b/c.rs", "crate::b::E": "k/src/b/mod.rs", "crate::b": "k/src/b/mod.rs", "super::b::c": "k/src/b/c.rs", "self::x::Y": "k/src/a/x.rs", "serde::Serialize": None},
        "k/src/a/x.rs": {"super::super::b": "k/src/b/mod.rs"},
        "k/src/b/mod.rs": {"mod c": "k/src/b/c.rs"},
        "g/x/a.go": {"fmt": None, "example.com/m/g/y": "g/y/a.go"},
        "j/com/x/A.java": {"com.x.B": "j/com/x/B.java", "com.x.B.f": "j/com/x/B.java", "java.util.List": None},
        "c/a.c": {"b.h": "c/b.h", "inc/z.h": "c/deep/inc/z.h", "stdio.h": None},
    }
    assert targets(spark, tree) == {(p, s): t for p, found in want.items() for s, t in found.items()}


def test_the_end_of_a_path_names_the_shallowest_file(spark):
    tree = {"a/b/lib/x.py": "", "z/lib/x.py": "", "y/lib/x.py": "", "q/t.py": "import lib.x\n", "z/t.py": "import lib.x\n"}
    assert targets(spark, tree) == {("q/t.py", "lib.x"): "y/lib/x.py", ("z/t.py", "lib.x"): "z/lib/x.py"}


def test_no_files(spark):
    assert targets(spark, {"a.md": "x"}) == {}


def stored_edges(store):
    return sorted((r.src.kind, r.src.id, r.dst.kind, r.dst.id, r.kind, r.owner) for r in store.table("edges").collect())


def test_edges_follow_every_change(spark, tmp_path):
    """After any sequence of additions, changes and removals the edges are those of a store that is built at once."""
    rng = random.Random(5)
    names = [f"{d}m{i}.py" for d in ("", "a/", "a/b/", "c/") for i in range(3)]
    body = lambda: "".join(f"from {rng.choice(['', '.', 'a.', 'b.', 'c.'])}m{rng.randint(0, 2)} import f\n" for _ in range(3)) + f"def f{rng.randint(0, 3)}(x):\n    return x\n"
    store, tree = Store(spark, str(tmp_path), "kept"), {n: body() for n in names[:5]}
    config = IndexConfig("fast", repo="r")
    for step in range(4):
        for n in rng.sample(names, 3):
            if n in tree and rng.random() < 0.5:
                del tree[n]
            else:
                tree[n] = body()
        index_files(store, frame(spark, tree), config)
        whole = Store(spark, str(tmp_path), f"whole{step}")
        index_files(whole, frame(spark, tree), config)
        assert stored_edges(store) == stored_edges(whole)
    kinds = {r.kind for r in store.table("edges").select("kind").distinct().collect()}
    assert kinds == {"BelongsTo", "Contains", "DefinedIn", "Defines", "Imports", "ImportedBy"}


def test_one_change_writes_the_edges_of_its_neighbours_alone(spark, tmp_path):
    tree = {f"p/m{i}.py": f"import m{i + 1}\n" for i in range(30)}
    store, config = Store(spark, str(tmp_path)), IndexConfig("fast")
    index_files(store, frame(spark, tree), config)
    del tree["p/m10.py"]
    index_files(store, frame(spark, tree), config)
    last = store.manifest().tables["edges"].segments[-1]
    assert (last.gone_rows, last.rows) == (2, 4)  # the file that went, and the one that imports it: its repository and its import
    links = store.table("edges").where("kind = 'Imports' and owner = 'p/m9.py'").collect()
    assert [r.dst.id for r in links] == ["external:m10"]


def test_graph_view_of_an_indexed_tree(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkloom.functions.text import after_colon

    store = Store(spark, str(tmp_path))
    index_files(store, frame(spark, {"a.py": "import b\nimport os\ndef run(x):\n    pass\n", "b.py": "x = 1\n"}), IndexConfig("fast"))
    edges = store.table("edges")
    known = edges.where("kind = 'BelongsTo'").select(F.col("src.id").alias("id"), after_colon(F.col("src.id")).alias("path")).distinct()
    hit = graph.find_file(known, "a.py").first()
    view = sorted(tuple(r) for r in graph.file_view(edges, known, hit.id).collect())
    assert view == [("import", "b.py"), ("import", "os (external)"), ("related", "b.py"), ("symbol", "run")]
