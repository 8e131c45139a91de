"""Usage: [--help] generate|print|sort ...

    generate [--random] <count> <output>      <count> integers from <count> down to 1, or random ones
    print <input>                             all integers, one a line
    sort <input> <output> [<mem_size>]        ascending; mem_size: bytes of a range

An input is a file or a folder of part files. An output is one file, or with a slash at its end a folder of part files.
Exit codes: 0 done, 1 failed, 2 wrong usage.
"""

from __future__ import annotations

import sys
import uuid


def main(args: list[str]) -> int:
    if "--help" in args[:1]:
        print(__doc__)
        return 0
    random = "--random" in args[1:2]
    rest = args[2:] if random else args[1:]
    mode = args[0] if args else ""
    numbers = {"generate": rest[:1], "sort": rest[2:]}.get(mode, [])
    if len(rest) not in {"generate": (2,), "print": (1,), "sort": (2, 3)}.get(mode, ()) or random and mode != "generate" or not all(n.isdecimal() and n.isascii() for n in numbers):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .operators import sorting
    from .sources import u64

    def written(target: str, write) -> None:
        """write(folder), then one file of its parts unless a folder is asked for."""
        if target.endswith("/"):
            return write(target.rstrip("/"))
        folder = f"{target}.{uuid.uuid4().hex}"
        write(folder)
        u64.join_parts(folder, target)

    spark = SparkSession.builder.appName("basalt").getOrCreate()
    try:
        if mode == "generate":
            written(rest[1], lambda folder: u64.write_keys(sorting.generate(spark, int(rest[0]), random), folder))
        elif mode == "print":
            for row in u64.read(spark, rest[0]).toLocalIterator():
                print(row.v)
        else:
            written(rest[1], lambda folder: sorting.external_sort(spark, rest[0], folder, int(rest[2]) if len(rest) == 3 else None))
    except Exception as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
