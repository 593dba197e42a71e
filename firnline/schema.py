"""Column conventions: one row of `obs` is one image pair at one pixel; a missing value is NULL, never NaN."""

PIXEL = ("x", "y")
OBS = "x double, y double, xi int, yi int, date1 date, date2 date, mid_date timestamp_ntz, temporal_baseline int, vx double, vy double, errorx double, errory double, sensor string, source string"
ILF = "x double, y double, k int, date1 date, date2 date, result_dx double, result_dy double, xcount_x double, xcount_y double, error_x double, error_y double"
QUALITY = "x double, y double, n_obs int, n_epoch int, n_iter int, normr array<double>, sigma0_x double, sigma0_y double, t_x double, t_y double"
RLF = "x double, y double, date1 date, date2 date, vx double, vy double, xcount_x double, xcount_y double, error_x double, error_y double"
#: Days in the year of velocities.
YEAR = 365
