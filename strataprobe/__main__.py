"""python -m strataprobe PATH...: profile tables and print a metadata record."""

from __future__ import annotations

import argparse
import json
import sys

from .plans.orchestrator import Orchestrator, result_details
from .plans.roles import TOPOLOGIES
from .session import create_session
from .sources import create_context


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataprobe", description="Profile tables and write a metadata record.")
    parser.add_argument("paths", nargs="+", help="files or one folder")
    parser.add_argument("--name", default="dataset")
    parser.add_argument("--standard", default="spatial_ecological", help="a standard by name, or a file")
    parser.add_argument("--topology", default="fast", choices=sorted(TOPOLOGIES))
    parser.add_argument("--master", help="Spark master; the environment's by default")
    parser.add_argument("--details", action="store_true", help="print every step's results")
    args = parser.parse_args(argv)
    spark = create_session(master=args.master)
    try:
        context = create_context(spark, args.paths if len(args.paths) > 1 else args.paths[0], args.name)
        result = Orchestrator(spark, args.topology, args.standard).run(context)
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if result is None:
        return 1
    print(json.dumps(result_details(result) if args.details else result.final_metadata, indent=2, default=str))
    return 0 if result.success else 1


if __name__ == "__main__":
    sys.exit(main())
