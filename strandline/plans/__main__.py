"""python -m strandline.plans [--debug] [--observed] SCRIPT: runs a script and prints its last result, or all of them."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import ScriptError
from .session import Session


def main(args: list[str]) -> int:
    debug = any(a in ("--debug", "-d") for a in args)
    profile = "observed" if "--observed" in args else "documented"
    paths = [a for a in args if not a.startswith("-")]
    if len(paths) != 1:
        print(__doc__)
        return 2
    session = Session(SparkSession.builder.appName("strandline").getOrCreate(), profile)
    try:
        script = Path(paths[0]).read_text(encoding="utf-8")
        results = session.run(script)
        if debug:
            print(session.describe(script, results))
        for r in results if debug else results[-1:]:
            print(r.text())
    except (ScriptError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
