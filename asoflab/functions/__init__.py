"""Part of asoflab; see README."""
