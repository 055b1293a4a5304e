"""Scans, run records, file trees and published outputs."""
