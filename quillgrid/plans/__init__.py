"""Registered queries; importing the package fills the catalog."""
