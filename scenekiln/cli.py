"""Command line: version, config-show, generate, pack-backgrounds, pack-cards."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from scenekiln.config import Settings
from scenekiln.functions.geometry import CENTRE_TOLERANCE, HULL_AREA, MAX_HIDDEN, MIN_CONTOUR_AREA, MIN_SOLIDITY

VERSION = "0.1.0"


def _least(n: int):
    def check(text: str) -> int:
        value = int(text)
        if value < n:
            raise argparse.ArgumentTypeError(f"is {n} at least")
        return value

    return check


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("is a share from 0 to 1")
    return value


def _ranges(args: argparse.Namespace):
    """The ranges of turn, size and move, those that were not given by default."""
    from scenekiln.operators.sampling import AugmentRange

    given = {"rotation_deg": args.rotation, "scale": args.scale, "translate_frac": args.translate}
    if any(r and r[0] > r[1] for r in given.values()):
        raise SystemExit("a range goes from its lower to its higher end")
    return AugmentRange(**{k: tuple(r) for k, r in given.items() if r})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scenekiln", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("config-show")
    make = sub.add_parser("generate")
    make.add_argument("--backgrounds", required=True)
    make.add_argument("--cards", required=True)
    make.add_argument("--output", required=True)
    make.add_argument("-n", "--count", type=_least(1), default=10)
    make.add_argument("--cards-per-scene", type=int, choices=(2, 3), default=2)
    make.add_argument("--canvas-size", type=_least(64), default=720)
    make.add_argument("--seed", type=int)
    make.add_argument("--draws", choices=("sequence", "hashed"), default="sequence")
    for name, what in (("rotation", "degrees"), ("scale", "sizes"), ("translate", "moves in fractions of the canvas")):
        make.add_argument(f"--{name}", type=float, nargs=2, metavar=("LOW", "HIGH"), help=f"range of {what}")
    make.add_argument("--hidden", type=_share, default=MAX_HIDDEN, help="how much of a corner may lie under the next card")
    for name, size in (("pack-backgrounds", 1024), ("pack-cards", 512)):
        pack = sub.add_parser(name)
        pack.add_argument("source")
        pack.add_argument("output")
        pack.add_argument("--shard-size", type=_least(1), default=size)
        if name == "pack-cards":
            pack.add_argument("--no-hulls", action="store_true")
            pack.add_argument("--min-area", type=float, default=MIN_CONTOUR_AREA, help="least area of an outline")
            pack.add_argument("--min-solidity", type=_share, default=MIN_SOLIDITY, help="share of its hull that an outline fills at least")
            pack.add_argument("--hull-area", type=float, nargs=2, default=HULL_AREA, metavar=("LOW", "HIGH"), help="plausible areas of a symbol")
            pack.add_argument("--tolerance", type=float, nargs=2, default=CENTRE_TOLERANCE, metavar=("X", "Y"), help="how far off the zone's centre, in shares of its sides")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = Settings.load()
    if args.command == "version":
        print(VERSION)
    elif args.command == "config-show":
        print(json.dumps(asdict(settings), indent=2))
    else:
        from scenekiln.plans import pipelines
        from scenekiln.session import build_session

        spark = build_session()
        if args.command == "generate":
            seed = settings.seed if args.seed is None else args.seed
            labels = pipelines.generate(spark, args.backgrounds, args.cards, args.output, args.count, args.cards_per_scene, args.canvas_size, seed, _ranges(args), args.hidden, args.draws)
            print(f"{args.count} scenes, {labels.count()} labels")
        elif args.command == "pack-backgrounds":
            print(f"{pipelines.pack_backgrounds(spark, args.source, args.output, args.shard_size)} shards")
        else:
            gates = {} if args.no_hulls else {"min_area": args.min_area, "min_solidity": args.min_solidity, "hull_area": tuple(args.hull_area), "tolerance": tuple(args.tolerance)}
            print(f"{pipelines.pack_cards(spark, args.source, args.output, args.shard_size, extract_hulls=not args.no_hulls, **gates)} shards")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
