"""The ellipsoidal polyconic projection and its inverse as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Newton steps of the inverse; each doubles the right digits.
STEPS = 8


@dataclass(frozen=True)
class Polyconic:
    """Semi-major axis and flattening, origin in degrees, false origin in metres."""

    a: float
    f: float
    lat0: float
    lon0: float
    x0: float
    y0: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    def _series(self) -> tuple[float, ...]:
        """Coefficients of the meridian's arc over a: of phi, and of sines of its multiples by 2, 4, 6 and 8."""
        e = self.e2
        return (
            1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256 - 175 * e**4 / 16384,
            -(3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024 + 105 * e**4 / 4096),
            15 * e**2 / 256 + 45 * e**3 / 1024 + 525 * e**4 / 16384,
            -(35 * e**3 / 3072 + 175 * e**4 / 12288),
            315 * e**4 / 131072,
        )

    def arc(self, phi: Column) -> Column:
        """The meridian's length from the equator, over a."""
        c = self._series()
        total = c[0] * phi
        for i in range(1, 5):
            total = total + c[i] * F.sin(2 * i * phi)
        return total

    def slope(self, phi: Column) -> Column:
        c = self._series()
        total = F.lit(c[0])
        for i in range(1, 5):
            total = total + 2 * i * c[i] * F.cos(2 * i * phi)
        return total

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """x and y in metres of degrees."""
        phi, wide = F.radians(lat), F.radians(lon - self.lon0)
        start = self.arc(F.radians(F.lit(self.lat0)))
        cot = F.cos(phi) / F.sin(phi) / F.sqrt(1 - self.e2 * F.pow(F.sin(phi), 2))
        turn = wide * F.sin(phi)
        flat = F.abs(phi) < 1e-12
        x = F.when(flat, wide).otherwise(F.try_multiply(cot, F.sin(turn)))
        y = F.when(flat, -start).otherwise(self.arc(phi) - start + cot * (1 - F.cos(turn)))
        return self.x0 + self.a * x, self.y0 + self.a * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees of metres, within 90 degrees of the middle meridian."""
        u = (x - self.x0) / self.a
        v = (y - self.y0) / self.a + self.arc(F.radians(F.lit(self.lat0)))
        far = u * u + v * v

        def step(phi: Column) -> Column:
            c = F.sqrt(1 - self.e2 * F.pow(F.sin(phi), 2)) * F.tan(phi)
            m, dm = self.arc(phi), self.slope(phi)
            above = v * (c * m + 1) - m - 0.5 * (m * m + far) * c
            below = self.e2 * F.sin(2 * phi) * (m * m + far - 2 * v * m) / (4 * c) + (v - m) * (c * dm - 2 / F.sin(2 * phi)) - dm
            return F.when(F.abs(phi) < 1e-12, phi).otherwise(phi - above / below)

        steps = F.sequence(F.lit(1), F.lit(STEPS))
        phi = F.when(F.abs(v) < 1e-12, F.lit(0.0)).otherwise(F.aggregate(steps, v, lambda p, _: step(p)))
        c = F.sqrt(1 - self.e2 * F.pow(F.sin(phi), 2)) * F.tan(phi)
        wide = F.when(F.abs(phi) < 1e-12, u).otherwise(F.asin(F.greatest(F.least(u * c, F.lit(1.0)), F.lit(-1.0))) / F.sin(phi))
        return F.degrees(phi), F.degrees(wide) + self.lon0

    def ring(self, ring: Column) -> Column:
        """A ring of struct<x: lon, y: lat> in metres."""

        def point(p: Column) -> Column:
            x, y = self.forward(p.y, p.x)
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform(ring, point)


#: The GRS 80 ellipsoid, and the origin of Brazil's polyconic projection (EPSG 5880).
BRAZIL = Polyconic(6378137.0, 1 / 298.257222101, 0.0, -54.0, 5_000_000.0, 10_000_000.0)
