"""Command line: python -m terracell <command> ... ; exit codes 0, 1 on failure, 2 without a command."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

import terracell
from terracell.operators import filters, ground, metrics, raster, registration, tiling
from terracell.sources.formats import read, write


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("terracell")
    top.add_argument("--version", action="version", version=terracell.__version__)
    commands = top.add_subparsers(dest="command")

    def add(name: str, output: bool = True, inputs: tuple = ("input",)) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for i in inputs:
            p.add_argument(i)
        if output:
            p.add_argument("-o", "--output", required=True)
        p.add_argument("--platform", default=None)
        return p

    add("info", output=False)
    p = add("classify")
    p.add_argument("--algorithm", choices=("csf", "pmf"), default="csf")
    p = add("filter")
    p.add_argument("--method", choices=("voxel", "sor", "radius"), default="voxel")
    for name, kind, value in (("voxel-size", float, 0.1), ("nb-neighbors", int, 20), ("std-ratio", float, 2.0), ("radius", float, 0.5), ("min-neighbors", int, 2)):
        p.add_argument(f"--{name}", type=kind, default=value)
    add("convert")
    p = add("dem")
    p.add_argument("--resolution", type=float, default=1.0)
    p = add("register", inputs=("source", "target"))
    p.add_argument("--max-distance", type=float, default=1.0)
    p = add("tile")
    p.add_argument("--tile-size", type=float, default=500.0)
    return top


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "register":
        source, target = read(spark, a.source, a.platform), read(spark, a.target, a.platform)
        found = registration.icp(source, target, a.max_distance)
        write(source.with_df(registration.transformed(source.df, found.transform)), a.output)
        print(json.dumps({"fitness": found.fitness, "inlier_rmse": found.inlier_rmse, "converged": found.converged}))
        return
    cloud = read(spark, a.input, a.platform)
    if a.command == "info":
        print(json.dumps(metrics.cloud_statistics(cloud).first().asDict()))
    elif a.command == "classify":
        write((ground.classify_ground_csf if a.algorithm == "csf" else ground.classify_ground_pmf)(cloud), a.output)
    elif a.command == "filter":
        if a.method == "voxel":
            out = filters.voxel_downsample(cloud, a.voxel_size)
        elif a.method == "sor":
            out = filters.statistical_outlier_removal(cloud, a.nb_neighbors, a.std_ratio)[0]
        else:
            out = filters.radius_outlier_removal(cloud, a.radius, a.min_neighbors)[0]
        write(out, a.output)
    elif a.command == "convert":
        write(cloud, a.output)
    elif a.command == "dem":
        found = raster.node_dem(cloud, a.resolution)
        if a.output.endswith((".tif", ".tiff")):
            raster.export_geotiff(found, a.output)
        else:
            import numpy as np

            np.save(a.output, found.dense())
    else:
        tiling.write_tiles(cloud, a.output, a.tile_size)


def main(arguments: list[str] | None = None) -> int:
    parser = _parser()
    a = parser.parse_args(arguments)
    if not a.command:
        parser.print_help()
        return 2
    try:
        _run(SparkSession.builder.getOrCreate(), a)
    except Exception as e:
        print(f"terracell: {e}", file=sys.stderr)
        return 1
    return 0
