"""Pinhole cameras and poses as column expressions. A pose is a position and a right, up, forward basis; +z is forward."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Mat, Quat, Vec, col, num, pick, sqrt


class Intrinsics(NamedTuple):
    width: Column
    height: Column
    fx: Column
    fy: Column
    cx: Column
    cy: Column

    @classmethod
    def of(cls, *values) -> Intrinsics:
        return cls(*map(num, values))

    @classmethod
    def from_vertical_fov(cls, width, height, fov) -> Intrinsics:
        width, height = num(width), num(height)
        f = height / (2 * F.tan(col(num(fov)) / 2))
        return cls(width, height, f, f, width / 2, height / 2)

    def depth_projection(self, near, far) -> Mat:
        """Clip matrix for y down, z forward and depths in [0, 1]."""
        near, far = num(near), num(far)
        return Mat(
            [
                [2 * self.fx / self.width, 0.0, 2 * self.cx / self.width - 1, 0.0],
                [0.0, 2 * self.fy / self.height, 2 * self.cy / self.height - 1, 0.0],
                [0.0, 0.0, far / (far - near), -(far * near) / (far - near)],
                [0.0, 0.0, 1.0, 0.0],
            ]
        )

    def webgl_projection(self, near, far) -> Mat:
        """Clip matrix for y up, z backward and depths in [-1, 1]."""
        near, far = num(near), num(far)
        return Mat(
            [
                [2 * self.fx / self.width, 0.0, 1 - 2 * self.cx / self.width, 0.0],
                [0.0, 2 * self.fy / self.height, 2 * self.cy / self.height - 1, 0.0],
                [0.0, 0.0, -(far + near) / (far - near), -2 * far * near / (far - near)],
                [0.0, 0.0, -1.0, 0.0],
            ]
        )


class Pose(NamedTuple):
    position: Vec
    right: Vec
    up: Vec
    forward: Vec

    @classmethod
    def look_at(cls, position: Vec, target: Vec, up: Vec) -> Pose:
        forward = (target - position).normalised()
        right = up.cross(forward).normalised()
        return cls(position, right, forward.cross(right), forward)

    @classmethod
    def from_world_to_camera(cls, rotation: Quat, translation: Vec) -> Pose:
        """From a world-to-camera rotation and translation: the rows of the rotation are the basis."""
        rows = [Vec(*row) for row in rotation.matrix().rows]
        back = rotation.normalised().conjugate().rotate(translation) * -1.0
        return cls(back, rows[0], rows[1], rows[2])

    def to_world_to_camera(self) -> tuple[Quat, Vec]:
        turn = Mat([self.right, self.up, self.forward])
        return turn.quaternion(), turn.apply(self.position) * -1.0

    def to_camera(self, p: Vec) -> Vec:
        """Right, up, forward coordinates."""
        to = p - self.position
        return Vec(to.dot(self.right), to.dot(self.up), to.dot(self.forward))

    def project(self, lens: Intrinsics, p: Vec) -> tuple[Column, Column, Column]:
        """(u, v, depth) in pixels; NULL behind the camera."""
        c = self.to_camera(p)
        front = c.z > 0
        return (
            pick(front, lens.fx * c.x / c.z + lens.cx),
            pick(front, lens.fy * c.y / c.z + lens.cy),
            pick(front, c.z),
        )

    def pixel_ray(self, lens: Intrinsics, u, v) -> tuple[Vec, Vec]:
        x, y = (num(u) - lens.cx) / lens.fx, (num(v) - lens.cy) / lens.fy
        return self.position, (self.right * x + self.up * y + self.forward).normalised()

    def view_matrix(self) -> Mat:
        rows = [[*axis, -axis.dot(self.position)] for axis in (self.right, self.up, self.forward)]
        return Mat([*rows, [0.0, 0.0, 0.0, 1.0]])

    def webgl_view_matrix(self) -> Mat:
        """Forward is -z."""
        rows = [[*axis, -axis.dot(self.position)] for axis in (self.right, self.up, self.forward * -1.0)]
        return Mat([*rows, [0.0, 0.0, 0.0, 1.0]])


def reprojection_error(pose: Pose, lens: Intrinsics, p: Vec, u, v) -> Column:
    """Pixel distance between a point's projection and where it was seen; NULL behind the camera."""
    at = pose.project(lens, p)
    return sqrt((at[0] - num(u)) * (at[0] - num(u)) + (at[1] - num(v)) * (at[1] - num(v)))


def intrinsics_of_model(model: Column, params: Column) -> dict[str, Column]:
    """fx, fy, cx, cy (and radial k) of the camera models with at most one radial term; NULL for the others."""
    p = lambda k: F.get(params, F.lit(k))
    one = model.isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL")
    two = model == "PINHOLE"
    return {
        "fx": F.when(one | two, p(0)),
        "fy": F.when(one, p(0)).when(two, p(1)),
        "cx": F.when(one, p(1)).when(two, p(2)),
        "cy": F.when(one, p(2)).when(two, p(3)),
        "k": F.when(model == "SIMPLE_RADIAL", p(3)).when(one | two, 0.0),
    }


def camera_support(model: Column) -> Column:
    return (
        F.when(model.isin("SIMPLE_PINHOLE", "PINHOLE"), "supported")
        .when(model == "SIMPLE_RADIAL", "approximated")
        .otherwise("unsupported")
    )
