"""All queries of the library outside the training-data subpackage."""

from __future__ import annotations

from brindle.plans import annotations, evaluation, pixels, poses, rasters, regions, resampling, samples, scalars, surfaces, transforms
from brindle.registry import Registry

REGISTRY = Registry()
for part in (scalars, annotations, evaluation, pixels, poses, rasters, regions, resampling, samples, surfaces, transforms):
    part.register(REGISTRY)
