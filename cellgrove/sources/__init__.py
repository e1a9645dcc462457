"""Sources and sinks: seeded generators, quantised tables, trees and vectors on disk, VTU files, dense rasters."""
