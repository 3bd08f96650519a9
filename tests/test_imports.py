"""Import resolution of each language on small trees."""

from __future__ import annotations

import pytest

from graphloom.operators import imports

TREES = {
    "script": (
        {
            "src/a.ts": "import { b } from './b.js';\nimport c from '../lib/c';\nimport d from '@/util/d';\nexport * from './dir';\nimport x from 'react';\nconst e = require('./e');\nimport '../../out';\n",
            "src/b.ts": "", "lib/c.tsx": "", "src/dir/index.ts": "", "src/e.cjs": "", "src/util/d.ts": "", "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}',
            "pkg/app/f.ts": "import d from '@/d';\n", "pkg/tsconfig.json": '{"compilerOptions": {"baseUrl": "./app", "paths": {"@/*": ["none/*", "*"]}}}', "pkg/app/d.ts": "",
        },
        {("src/a.ts", "src/b.ts"), ("src/a.ts", "lib/c.tsx"), ("src/a.ts", "src/util/d.ts"), ("src/a.ts", "src/dir/index.ts"), ("src/a.ts", "src/e.cjs"), ("pkg/app/f.ts", "pkg/app/d.ts")},
    ),
    "python": (
        {"svc/main.py": "import util\nfrom pkg import one, two as t\nfrom .near import f\nfrom .. import top\nimport os\n", "svc/util.py": "", "svc/pkg/__init__.py": "", "svc/pkg/one.py": "", "util.py": "", "svc/near.py": "", "top.py": ""},
        {("svc/main.py", "svc/util.py"), ("svc/main.py", "svc/pkg/__init__.py"), ("svc/main.py", "svc/pkg/one.py"), ("svc/main.py", "svc/near.py"), ("svc/main.py", "top.py")},
    ),
    "go": (
        {"m/go.mod": "module x.y/m\n", "m/cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tu "x.y/m/util"\n)\n', "m/util/a.go": "package util\n", "m/util/b.go": "package util\n", "o/go.mod": "module x.y/o\n", "o/c.go": 'package o\nimport "x.y/m/util"\n'},
        {("m/cmd/main.go", "m/util/a.go"), ("m/cmd/main.go", "m/util/b.go")},
    ),
    "java": ({"src/main/java/a/b/C.java": "import a.d.E;\nimport static a.d.F;\nimport a.d.*;\nimport java.util.List;\n", "src/main/java/a/d/E.java": "", "src/main/java/a/d/F.java": ""}, {("src/main/java/a/b/C.java", "src/main/java/a/d/E.java"), ("src/main/java/a/b/C.java", "src/main/java/a/d/F.java")}),
    "kotlin": ({"k/A.kt": "import x.B\nimport x.C as D\n", "src/x/B.kt": "", "src/x/C.kt": ""}, {("k/A.kt", "src/x/B.kt"), ("k/A.kt", "src/x/C.kt")}),
    "csharp": ({"A.cs": "using X.B;\nusing System;\n", "src/X/B.cs": ""}, {("A.cs", "src/X/B.cs")}),
    "scala": ({"A.scala": "import x.B\nimport y.{C, D => E}\nimport z.Q\n", "s/x/B.scala": "", "s/y/C.scala": "", "s/y/D.scala": "", "s/z/package.scala": ""}, {("A.scala", "s/x/B.scala"), ("A.scala", "s/y/C.scala"), ("A.scala", "s/y/D.scala"), ("A.scala", "s/z/package.scala")}),
    "swift": ({"Sources/App/main.swift": "import Core\nimport struct Core.X\nimport Foundation\n", "Sources/Core/a.swift": "", "Sources/Core/b.swift": ""}, {("Sources/App/main.swift", "Sources/Core/a.swift"), ("Sources/App/main.swift", "Sources/Core/b.swift")}),
    "ruby": ({"lib/a.rb": "require_relative 'b'\nrequire 'x/c'\nrequire 'json'\n# require 'd'\n", "lib/b.rb": "", "lib/x/c.rb": "", "d.rb": ""}, {("lib/a.rb", "lib/b.rb"), ("lib/a.rb", "lib/x/c.rb")}),
    "php": ({"p/composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Deep\\\\": "deep"}}}', "p/src/A.php": "use App\\B\\C;\nuse App\\Deep\\D;\nuse Other\\E;\n", "p/src/B/C.php": "", "p/deep/D.php": ""}, {("p/src/A.php", "p/src/B/C.php"), ("p/src/A.php", "p/deep/D.php")}),
    "rust": ({"c/Cargo.toml": "", "c/src/lib.rs": "mod a;\npub mod d;\nuse crate::a::b::Item;\n", "c/src/a.rs": "mod b;\nuse super::d::X;\n", "c/src/a/b.rs": "", "c/src/d/mod.rs": ""}, {("c/src/lib.rs", "c/src/a.rs"), ("c/src/lib.rs", "c/src/d/mod.rs"), ("c/src/lib.rs", "c/src/a/b.rs"), ("c/src/a.rs", "c/src/a/b.rs"), ("c/src/a.rs", "c/src/d/mod.rs")}),
    "c": ({"src/a.c": '#include "b.h"\n#include "deep/only.h"\n#include <stdio.h>\n#include "twice.h"\n', "src/b.h": "", "x/deep/only.h": "", "x/twice.h": "", "y/twice.h": ""}, {("src/a.c", "src/b.h"), ("src/a.c", "x/deep/only.h")}),
}


@pytest.mark.parametrize("language", sorted(TREES))
def test_imports(spark, language):
    tree, want = TREES[language]
    df = spark.createDataFrame([("g", p, c) for p, c in tree.items()] + [("h", "src/a.ts", "import './b.js'"), ("g", None, "x"), ("g", "n.ts", None)], "graphId string, path string, content string")
    assert {(r["importer"], r["path"]) for r in imports.RESOLVERS[language](df).where("graphId = 'g'").collect()} == want


def test_map_of_all_languages(spark):
    rows = [("g", p, c) for tree, _ in (TREES["script"], TREES["ruby"]) for p, c in tree.items()]
    df = spark.createDataFrame([*rows, *rows], "graphId string, path string, content string")
    got = [(r["importer"], r["path"]) for r in imports.import_map(df).collect()]
    assert len(got) == len(set(got)) and set(got) == TREES["script"][1] | TREES["ruby"][1]
    assert imports.import_map(df.limit(0)).count() == 0
