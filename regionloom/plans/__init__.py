"""Reusable physical shapes: binned range joins, interval merging, ordered scans."""
